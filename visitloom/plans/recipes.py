"""The questions that come with the workbench, over a shop's history registered as views.

Each has an oracle of its own that goes back to the given tables. The views live in a copy of the
caller's session, so they hide none of the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.plans.base import QUERIES, SQL, VISITS
from visitloom.sources.tables import table, visits
from visitloom.workbench import Recipe, copied

#: Recipes, each with the DuckDB SQL over the given tables that it must equal.
ASKED = (
    (
        Recipe(
            "Most faithful visitors", "The people who came on the most different days, and the days each came.",
            "SELECT visitor, count(DISTINCT came_on) AS days, max(minutes) AS longest FROM stays GROUP BY visitor HAVING count(DISTINCT came_on) > 1 ORDER BY days DESC, visitor",
            "visitor", "days",
        ),
        f"""WITH {VISITS} SELECT c_name AS visitor, count(DISTINCT day) AS days, max(seconds // 60) AS longest FROM visits, customer
        WHERE actor = c_custkey GROUP BY c_custkey, c_name HAVING min(day) < max(day)""",
    ),
    (
        Recipe("Rhythm of the week", "How many stays end on each day of the week, Monday first.", "SELECT weekday(to_date(came_on)) AS weekday, count(*) AS stays, sum(minutes) AS minutes FROM stays GROUP BY ALL ORDER BY weekday", "weekday", "stays"),
        f"""WITH {VISITS} SELECT ((isodow(day::DATE) - 1)::INT) AS weekday, count(*) AS stays, sum(seconds // 60)::BIGINT AS minutes FROM visits JOIN customer ON c_custkey = actor GROUP BY 1""",
    ),
    (
        Recipe(
            "Stays around the clock", "What share of all stays begins in each quarter of the day.",
            "WITH q AS (SELECT begun div 21600 % 4 AS quarter FROM stays) SELECT quarter, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM q GROUP BY quarter ORDER BY quarter",
            "quarter", "percent",
        ),
        f"""WITH {VISITS}, n AS (SELECT count(*) AS n FROM visits JOIN customer ON c_custkey = actor)
        SELECT (started_at // 21600) % 4 AS quarter, round(100.0 * count(*) / any_value(n), 2) AS percent FROM visits JOIN customer ON c_custkey = actor, n GROUP BY 1""",
    ),
    (
        Recipe("Worth by kind of stay", "Whether long kinds of stay are also the ones that pay.", "SELECT kind, avg(minutes) AS minutes, avg(taken) AS taken FROM stays GROUP BY kind", "minutes", "taken", "scatter"),
        f"""WITH {VISITS} SELECT place AS kind, sum(seconds // 60) / count(*) AS minutes, sum(loot) / count(*) AS taken FROM visits JOIN customer ON c_custkey = actor GROUP BY place""",
    ),
    (
        Recipe(
            "Goods that come back", "Makers by the pieces that buyers sent back, with the pieces they kept.",
            "SELECT maker, sum(pieces) FILTER (WHERE sent_back) AS back, sum(pieces) FILTER (WHERE NOT sent_back) AS kept FROM sales GROUP BY maker ORDER BY back DESC NULLS LAST, maker",
            "maker", "back",
        ),
        """SELECT p_brand AS maker, sum(CASE l_returnflag WHEN 'R' THEN l_quantity::BIGINT END)::BIGINT AS back, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT END)::BIGINT AS kept
        FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand""",
    ),
    (
        Recipe("Orders month by month", "The trade of each month, and the dearest order in it.", "SELECT month, count(*) AS orders, max(price) AS dearest FROM baskets GROUP BY month ORDER BY month", "month", "orders", "line"),
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(o_orderkey) AS orders, max(o_totalprice) AS dearest FROM orders GROUP BY month",
    ),
    (
        Recipe(
            "Kinds of goods by rank", "The best-selling kinds of goods, and how far behind the best each is.",
            "WITH k AS (SELECT kind, sum(pieces) AS pieces FROM sales GROUP BY kind) SELECT kind, pieces, first_value(pieces) OVER (ORDER BY pieces DESC, kind) - pieces AS behind FROM k ORDER BY pieces DESC, kind",
            "kind", "behind",
        ),
        """SELECT p_type AS kind, sum(l_quantity::BIGINT)::BIGINT AS pieces, ((SELECT max(s) FROM (SELECT sum(l_quantity::BIGINT) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)) - sum(l_quantity::BIGINT))::BIGINT AS behind
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""",
    ),
    (
        Recipe("What was ordered last", "The latest baskets as they stand.", "SELECT basket, buyer, price, urgency FROM baskets ORDER BY placed DESC, basket DESC LIMIT 25"),
        "SELECT o_orderkey AS basket, o_custkey AS buyer, o_totalprice AS price, o_orderpriority AS urgency FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25",
    ),
)
RECIPES = tuple(r for r, _ in ASKED)


def history(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The relations that the questions are about, out of the tables of a folder."""
    v, c = visits(spark, d), table(spark, d, "customer")
    stays = v.join(c, F.col("actor") == F.col("c_custkey")).select(
        F.col("c_name").alias("visitor"), F.col("day").alias("came_on"), F.col("started_at").alias("begun"), F.expr("seconds div 60").alias("minutes"), F.col("place").alias("kind"), F.col("loot").alias("taken")
    )
    sales = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("maker"), F.col("p_type").alias("kind"), F.col("l_quantity").cast("long").alias("pieces"), (F.col("l_returnflag") == "R").alias("sent_back")
    )
    baskets = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("basket"), F.col("o_custkey").alias("buyer"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("urgency"),
        F.col("o_orderdate").alias("placed"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )
    return {"stays": stays, "sales": sales, "baskets": baskets}


def register_history(spark: SparkSession, d: str) -> None:
    for name, df in history(spark, d).items():
        df.createOrReplaceTempView(name)


def _question(recipe: Recipe):
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = copied(spark)
        register_history(own, d)
        return own.sql(recipe.sql)

    return run


for _r, _sql in ASKED:
    _name = "recipe_" + "_".join(_r.name.lower().split())
    QUERIES[_name], SQL[_name] = _question(_r), _sql
