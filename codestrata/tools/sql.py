"""Read-only SQL over temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 50
#: What an analysed SELECT may be made of: plan nodes and expressions of these packages, and the scan of the empty tables that it is analysed on.
PACKAGES = ("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.plans.", "org.apache.spark.sql.execution.LogicalRDD")
#: But no expression that calls methods by name or user code, and no node that runs programs or changes anything.
CALLS = re.compile(r"Reflect|UDF|UDAF|UDTF|Python|Pandas|Arrow")
CHANGES = re.compile(r"Script|Command|Insert|Create|Replace|Drop|Alter|Write|Delete|Update|Merge|MapElements|MapPartitions|MapGroups")


class NotReadOnly(ValueError):
    """The text is not a single SELECT, or it does more than read."""


def check_select(sql: str) -> str:
    """The statement, if it begins with SELECT; Spark itself rejects a second statement."""
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)select\b", text):
        raise NotReadOnly("Only SELECT statements are allowed.")
    return text


def check_plan(own: SparkSession, text: str, tables: dict[str, DataFrame]) -> None:
    """Analyse the statement on empty tables of the same columns and look at every node and expression of the plan.

    So however a call is written, it is seen by what it has become; nothing is run, and
    what the tables themselves are made of does not matter.
    """
    for name, df in tables.items():
        own.createDataFrame([], df.schema).createOrReplaceTempView(name)
    plan = own.sql(text)._jdf.queryExecution().analyzed().toJSON()
    for made in sorted(set(re.findall(r'"class":"([^"]+)"', plan))):
        name = made.rpartition(".")[2]
        if not made.startswith(PACKAGES) or CALLS.search(name) or (".plans." in made and CHANGES.search(name)):
            raise NotReadOnly(f"Not allowed in a query: {name}.")


def run_select(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A SELECT over the given tables; their views live in a session of their own, so none of the caller's are replaced."""
    text = check_select(sql)
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.runSQLOnFiles", "false")  # a path is no table
    check_plan(own, text, tables)
    for name, df in tables.items():
        _register(own, name, df)
    return own.sql(text)


def _register(own: SparkSession, name: str, df: DataFrame) -> None:
    """The DataFrame's plan as a view of another session of the same application."""
    view = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().logical())
    DataFrame(view, own).createOrReplaceTempView(name)


def as_text(df: DataFrame, rows: int = MAX_ROWS) -> str:
    """Header and rows parted by ` | `, at most `rows` of them; `No rows.` for none."""
    found = df.limit(rows + 1).collect()
    if not found:
        return "No rows."
    lines = [" | ".join(df.columns), *[" | ".join("NULL" if v is None else str(v) for v in r) for r in found[:rows]]]
    return "\n".join([*lines, *(["... more rows"] if len(found) > rows else [])])
