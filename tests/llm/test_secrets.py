import hashlib
import random
import re

from quarry.llm import secrets

SCHEMA = "doc_id bigint, text string, base string, hex int, assign int, pair string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, "", 0, 0, "") for i, t in data], SCHEMA)


RULES = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
          lambda m: len(m[2]) >= 6),
         ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
         ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, rule, ok) in enumerate(RULES) for m in rule.finditer(text or "") if ok(m)]
    return ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in sorted(found))


def texts():
    rng = random.Random(4)
    parts = ["password=", "Password : 'abc", "passwd=\"", "api_key=", "apikey:", "token = \"deadbeef01", "secret=ab", "AKIA", "AKIAAB12",
             "AKIA" + "X" * 16, "0123456789abcdef" * 2, "0123456789abcdef0123456", "é", "😀", " ", "\n", "=", ":", "'", "word",
             "password: token:abcdefg", "TOKEN=x.y_z-/+9", "ſecret=abcdefgh"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))) for i in range(400)]


def test_base_spans_match_brute_force(spark):
    data = texts() + [(900, None), (901, ""), (902, "x " * 100_000 + "password=hunter22 " + "ab" * 30_000)]
    got = {r.doc_id: r for r in secrets.scan(rows(spark, data)).collect()}
    assert len(got) == len(data)
    for i, t in data:
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("markov")] == [s for s in want.split(",") if s]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))


def test_markov_finds_random_tokens_and_spares_names(spark):
    rng = random.Random(1)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    words = "customer order shipment configuration maximum throughput partition handler available repository".split()
    data = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(60)]
    data += [(100 + i, f"token={key(32)} and password: {key(24)}") for i in range(40)]
    lone = {200 + i: key(32) + "7z" for i in range(20)}
    data += [(i, f"configuration {v} shipment") for i, v in lone.items()]
    data += [(300, "customerorder_configuration_2 maximum_throughput_partition_10 availablerepository3handler")]
    got = {r.doc_id: r for r in secrets.scan(rows(spark, data)).collect()}
    hits = [got[i].spans == f"markov:14:{14 + len(v)}" for i, v in lone.items()]
    assert sum(hits) >= 18 and got[300].n_markov == 0
    assert all(got[i].n_markov == 0 for i, _ in data if i < 200)


def test_copied_tokens_stay_secrets(spark):
    """Tokens in 2 and in 1,000 documents score as those in one."""
    rng = random.Random(2)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    words = "customer order shipment configuration maximum throughput partition handler available repository".split()
    data = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(60)]
    data += [(100 + i, f"token={key(32)} and password: {key(24)}") for i in range(40)]
    tokens = [key(32) + "7z" for _ in range(12)]
    for i, t in enumerate(tokens):
        data += [(10_000 * (i + 1) + j, f"configuration {t} shipment") for j in range(2 if i < 6 else 1000)]
    out = secrets.scan(rows(spark, data)).filter("doc_id >= 10000").collect()
    lost = {r.doc_id // 10_000 for r in out if r.spans != "markov:14:48"}
    assert len(out) == 6012 and not lost


def test_plan_is_native(spark):
    df = secrets.scan(rows(spark, [(1, "password=abcdefgh")] * 2))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    assert df.count() == 2 and secrets.scan(rows(spark, [])).count() == 0


def test_redact(spark):
    out = secrets.redact(rows(spark, [(1, "é password=abcdefgh x"), (2, None), (3, "plain")])).collect()
    assert {r.doc_id: r.text for r in out} == {1: "é " + "*" * 17 + " x", 2: None, 3: "plain"}
    assert out[0].asDict().keys() == {"doc_id", "text", "base", "hex", "assign", "pair"}
