"""Fuzzy value lookup and praise/complaint terms against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from quarry.functions.text import STOP_WORDS
from quarry.operators.feedback import keyness
from quarry.operators.policy import ADMIN_ROLES, ROLE_A, ROLE_B, ROLE_OTHER, _POLICY_ROLES, expand_roles, role_bit, role_set
from quarry.plans.values import find_values


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lookup_equals_edit_distance(spark):
    rng = random.Random(4)
    values = ["".join(rng.choices("abc", k=rng.randrange(0, 6))) for _ in range(60)] + ["Brand#12", "Brand#13", "ÉTÉ", None]
    words = ["".join(rng.choices("abcd", k=rng.randrange(0, 6))) for _ in range(80)] + ["brand#1", "BRAND#12", "brnad#12", "été", "ét", None]
    known = spark.createDataFrame([("d", v) for v in values] + [("e", "abc")], "dimension string, value string").filter("value IS NOT NULL")
    got = {(r.word, r.dimension, r.value, r.distance) for r in find_values(spark.createDataFrame([(w,) for w in words], "word string"), known).collect()}
    want = {(w, d, v, distance(w.lower(), v.lower())) for w in words if w is not None
            for d, v in [("d", v) for v in values if v is not None] + [("e", "abc")] if distance(w.lower(), v.lower()) <= 1}
    assert got == want


def test_keyness_by_definition(spark):
    rng = random.Random(9)
    words = ["good", "bad", "wheel", "brakes", "fast", "slow", "the", "is", "frame"]
    rows = [(p, " ".join(rng.choices(words, k=rng.randrange(0, 9))), rng.choice([0, 1, 1, None])) for p in "xyz" for _ in range(40)]
    rows += [("only praise", "good wheel", 1), ("none", "good", None), ("x", None, 1)]
    table = spark.createDataFrame(rows, "product string, comment_text string, satisfaction int")
    got = defaultdict(dict)
    for r in keyness(table, "product", 1000).collect():
        got[r.product][r.term] = (r.polarity, r.comments, r.ratio)
    assert set(got) == set("xyz")
    for p in "xyz":
        own = [(t or "", s) for q, t, s in rows if q == p and s is not None]
        n = Counter(s for _, s in own)
        seen = defaultdict(Counter)
        for text, s in own:
            tok = text.split()
            some = {t for t in tok if t not in STOP_WORDS} | {f"{a} {b}" for a, b in zip(tok, tok[1:]) if not {a, b} & set(STOP_WORDS)}
            for t in some:
                seen[t][s] += 1
        for term, c in seen.items():
            share = (c[0] + c[1]) / (n[0] + n[1])
            ratio = 2 * sum(c[s] * math.log(c[s] / (n[s] * share)) for s in (0, 1) if c[s])
            apart = c[1] * n[0] - c[0] * n[1]
            if apart:
                side = 1 if apart > 0 else 0
                assert got[p][term] == (("complaint", "praise")[side], c[side], pytest.approx(ratio, abs=2e-6))
            else:
                assert term not in got[p]


def test_role_sets(spark):
    rows = [(1, "PROMO"), (2, "SMALL"), (3, "OTHER"), (4, None)]
    table = spark.createDataFrame(rows, "article_id int, article_category string")
    sets = table.withColumn("role_set", role_set())
    got = defaultdict(set)
    for r in expand_roles(sets).collect():
        got[r.article_id].add(r.role)
    admin = ADMIN_ROLES[0]
    assert got == {1: {admin, ROLE_A}, 2: {admin, ROLE_B}, 3: {admin}, 4: {admin}}
    assert role_bit(ROLE_OTHER) == 1 << _POLICY_ROLES.index(ROLE_OTHER)
    with pytest.raises(ValueError):
        role_set(roles=tuple(f"r{i}" for i in range(63)))


def test_qualified_names():
    from quarry.plans.qualified import AmbiguousName, Names
    names = Names()
    assert len(names.dimensions()) == 17                            # 16 dimensions and the time dimension; gender is unbound
    assert {"dim_article.article_id", "dim_customer.customer_id", "fact_sales.article_id"} <= set(names.dimensions())
    assert names.resolve("article_price").table == "dim_article" and names.resolve("dim_customer.customer_id").table == "dim_customer"
    with pytest.raises(AmbiguousName, match="fact_sales.article_id, dim_article.article_id"):
        names.resolve("article_id")
    for unknown in ("nothing", "dim_article.total_price", "customer_gender"):
        with pytest.raises(KeyError):
            names.resolve(unknown)


def test_rows_join_named_tables_alone(spark):
    from conftest import SF_SMALL
    from quarry.plans.qualified import rows
    plan = rows(spark, SF_SMALL, ["sale_id", "total_price"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    both = rows(spark, SF_SMALL, ["fact_sales.article_id", "dim_article.article_id", "article_price"])
    assert both.columns == ["fact_sales__article_id", "dim_article__article_id", "article_price"]
    assert both.filter("fact_sales__article_id <> dim_article__article_id").count() == 0
