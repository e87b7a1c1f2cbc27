from quarry.operators import docs
from quarry.functions import text as X


def test_description_rows_are_chunk_zero_of_files_without_text(spark):
    files = spark.createDataFrame([("blog.a/p.png", "s1"), ("b.png", "s2"), (None, "s3"), ("mute.png", "s4")],
                                  "source_file string, stage_name string")

    def model(prompts):
        return ["" if "mute" in p else p.upper() for p in prompts]
    rows = docs.described_chunks(files, model)
    assert rows.columns == list(docs.CHUNK_COLUMNS)
    got = {r.source_file: r for r in rows.collect()}
    assert set(got) == {"blog.a/p.png", "b.png"}
    assert all(r.chunk_index == 0 and r.file_type == "IMAGE" for r in got.values())
    assert got["b.png"].chunk_text == X.DESCRIBE_PROMPT.replace("{0}", "b.png").upper()
    assert got["b.png"].product_category != got["blog.a/p.png"].product_category


def test_description_rows_of_no_files(spark):
    files = spark.createDataFrame([], "source_file string, stage_name string")
    assert docs.described_chunks(files, docs.echo_model).count() == 0
