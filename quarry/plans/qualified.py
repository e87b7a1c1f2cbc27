"""Qualified names of the semantic model, and its facts as row-level measures.

Three tables of the model share field names: an article id and a customer id stand in the
sales and in their dimension. ``Names`` knows all of them: ``table.field`` names one, a
bare name does when one table has it, or else is an error that lists the choices.
``rows`` returns dimensions and facts of one sale per row, un-aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import register
from quarry.plans.semantic import SALES_MODEL, UNBOUND_FIELDS, Field, SemanticModel
from quarry.sources import tables as T

# Keys of the dimensions, which the model lists beside the sales' own.
DIMENSION_KEYS = (
    Field("article_id", "dim_article", "dimension", "NUMBER"),
    Field("customer_id", "dim_customer", "dimension", "NUMBER"),
)


class AmbiguousName(KeyError):
    """A bare name that several tables have."""


class Names:
    def __init__(self, model: SemanticModel = SALES_MODEL, keys: Sequence[Field] = DIMENSION_KEYS):
        self.model = model
        self.fields = [f for f in [*model.fields.values(), *keys] if f.name not in UNBOUND_FIELDS]

    def dimensions(self) -> list[str]:
        """Qualified names of all dimensions, in model order of their tables."""
        order = list(self.model.tables)
        found = [f for f in self.fields if f.kind in ("dimension", "time_dimension")]
        return [f"{f.table}.{f.name}" for f in sorted(found, key=lambda f: order.index(f.table))]

    def resolve(self, name: str) -> Field:
        table, dot, bare = name.rpartition(".")
        found = [f for f in self.fields if f.name == bare and (not dot or f.table == table)]
        if not found:
            raise KeyError(f"unknown name {name!r}")
        if len(found) > 1:
            raise AmbiguousName(f"{name!r} is one of {', '.join(f'{f.table}.{f.name}' for f in found)}")
        return found[0]


def output_name(name: str) -> str:
    """Column of a result: ``table.field`` becomes ``table__field``, a bare name stays."""
    return name.replace(".", "__")


def rows(spark: SparkSession, sf_dir: str, names: Sequence[str], known: Names | None = None) -> DataFrame:
    """One row per sale with the named fields. Only tables that a name needs are joined, each
    read with its named columns and key."""
    known = known or Names()
    model = known.model
    wanted = [(name, known.resolve(name)) for name in names]
    others = [t for t in model.tables if t != model.fact_table and any(f.table == t for _, f in wanted)]
    links = {t: model.relationship_to(t) for t in others}

    def side(table: str, keys: list[str]) -> DataFrame:
        columns = sorted({f.name for _, f in wanted if f.table == table} | set(keys))
        df = model.tables[table].loader(spark, sf_dir, columns)
        return df.select(*[F.col(c).alias(f"{table}__{c}") for c in columns])

    out = side(model.fact_table, [r.left_column for r in links.values()])
    for table, r in links.items():
        out = out.join(side(table, [r.right_column]),
                       F.col(f"{model.fact_table}__{r.left_column}") == F.col(f"{table}__{r.right_column}"))
    return out.select(*[F.col(f"{f.table}__{f.name}").alias(output_name(name)) for name, f in wanted])


ROW_NAMES = ("sale_id", "fact_sales.article_id", "dim_article.article_id", "article_price", "total_price",
             "dim_customer.customer_id", "fact_sales.customer_id", "customer_region")


@register("row_level_facts", T.with_views(
    "SELECT fs.sale_id, fs.article_id AS fact_sales__article_id, da.article_id AS dim_article__article_id, da.article_price, "
    "fs.total_price, dc.customer_id AS dim_customer__customer_id, fs.customer_id AS fact_sales__customer_id, dc.customer_region "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id JOIN dim_customer dc ON fs.customer_id = dc.customer_id",
    "fact_sales", "dim_article", "dim_customer"))
def row_level_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List price and paid price of every sale, with both article and customer ids."""
    return rows(spark, sf_dir, ROW_NAMES)
