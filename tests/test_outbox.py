from quarry.operators import outbox

ROWS = "region string, subject string, body string"


def attempts(df):
    return sorted((r.recipient, r.attempt, r.status) for r in df.collect())


def test_failures_are_rows_and_retries_send_nothing_twice(spark, tmp_path):
    df = spark.createDataFrame([("NORTH", "s", "- a: $1"), ("SOUTH", "s", "- b: $2"), ("SOUTH", "s", "- b: $2"),
                                (None, None, None)], ROWS)
    path = str(tmp_path / "outbox")
    rows = outbox.messages(df, "region")
    first = outbox.deliver(rows, path, outbox.no_mail_to("S"))
    assert attempts(first) == [("", 1, "sent"), ("NORTH", 1, "sent"), ("SOUTH", 1, "failed")]
    [text] = [r.status_text for r in first.collect() if r.status == "failed"]
    assert text.startswith(outbox.FAILED_TEXT) and "- b: $2" in text
    for _ in range(2):
        assert attempts(outbox.deliver(rows, path, outbox.no_mail_to(""))) == attempts(first) + [("SOUTH", 2, "sent")]


def test_a_changed_body_is_another_message(spark, tmp_path):
    path = str(tmp_path / "outbox")
    for body in ("- a: $1", "- a: $2", "- a: $2"):
        df = spark.createDataFrame([("NORTH", "s", body)], ROWS)
        found = outbox.deliver(outbox.messages(df, "region"), path, outbox.no_mail_to(""))
    assert attempts(found) == [("NORTH", 1, "sent")] * 2 and found.select("message_id").distinct().count() == 2


def test_long_bodies_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("N", "s", "w " * 501), ("S", "s", "w")], ROWS)
    assert {r.recipient: r.is_long for r in outbox.messages(df, "region").collect()} == {"N": True, "S": False}
    none = outbox.messages(df.filter("region = ''"), "region")
    assert outbox.deliver(none, str(tmp_path / "outbox"), outbox.no_mail_to("")).count() == 0
