"""A read-only SQL workbench over registered views: gate, limits and a plain answer.

Spark's own parser decides what a statement is. The gate walks what it has parsed, subqueries and
EXPLAIN included, and lets through only what three lists allow: nodes that ask, relations that are
registered, and functions that compute from their arguments. It then bounds rows, cells and time,
and renders the answer.
"""

from __future__ import annotations

import datetime as dt
import math
import threading
import time
import uuid
from dataclasses import dataclass
from decimal import Decimal

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# Fixed values of the answer contract.
ROW_CEILING = 5_000
DEFAULT_ROWS = 500
CELL_CHARACTERS = 2_000
SECONDS = 10.0
LABELS = 12
LABEL_CHARACTERS = 16

#: Parsed nodes that questions are made of; any other refuses the statement.
_ASKING = frozenset(
    """Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation
    Offset OneRowRelation OneRowRelation$ Pivot Project RepartitionByExpression Sample Sort SubqueryAlias Union Unpivot UnpivotTransformer UnresolvedHaving UnresolvedHint
    UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith View Window WithCTE
    WithWindowDefinition UnionLoop UnresolvedTableAliasColumns""".split()
)
#: Groups of built-in functions that compute from their arguments alone.
_GROUPS = frozenset(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs
    map_funcs math_funcs operator predicate_funcs string_funcs struct_funcs url_funcs window_funcs""".split()
)
#: Functions of other groups that do so too, and table functions that read nothing.
_ALSO = frozenset("typeof bitmap_count named_struct range explode explode_outer inline inline_outer posexplode posexplode_outer stack json_tuple".split())
#: Functions of those groups that look outside or wait.
_NOT = frozenset("raise_error assert_true sleep".split())


class Refused(ValueError):
    """The statement is no single read-only question, or failed; the message is for the reader."""


@dataclass
class Answer:
    columns: list[str]
    rows: list[list]
    truncated: bool
    elapsed_ms: int


def _items(seq):
    return (seq.apply(i) for i in range(seq.size()))


def _class(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(expression):
    yield expression
    for child in _items(expression.children()):
        yield from _expressions(child)


def _walk(plan):
    """(node, its expressions with theirs) of a parsed plan, its subqueries and its named parts."""
    own = [e for top in _items(plan.expressions()) for e in _expressions(top)]
    yield plan, own
    inner = [e.plan() for e in own if is_instance_of(SparkContext._gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression")]
    if _class(plan) == "UnresolvedWith":
        inner += [named._2() for named in _items(plan.cteRelations())]
    for below in [*_items(plan.children()), *inner]:
        yield from _walk(below)


_harmless: set[str] = set()


def harmless_functions(spark: SparkSession) -> set[str]:
    """Names of the functions that a question may use: built-in ones, by Spark's own groups."""
    if not _harmless:
        groups = {i.getName(): i.getGroup() for i in spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.listBuiltinFunctionInfos()}
        _harmless.update(({n for n, g in groups.items() if g in _GROUPS} | _ALSO) - _NOT)
    return _harmless


def _names(parts) -> list[str]:
    return [str(p).lower() for p in _items(parts)]


def check(spark: SparkSession, sql: str, relations: set[str] | None = None) -> None:
    """Raise unless ``sql`` is one question over registered relations: SELECT, WITH, VALUES or EXPLAIN.

    ``relations``: what may be read, else all views and tables of the session's present schema.
    Paths in place of names, other schemas, functions that reach the machine or the JVM, functions
    that a session has registered, scripts and commands are refused, wherever they stand.
    """
    if not sql or not sql.strip():
        raise Refused("There is nothing to run.")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        text = str(getattr(e, "java_exception", e)).splitlines()[0]
        raise Refused(text) from None
    if _class(plan) == "ExplainCommand":
        plan = plan.logicalPlan()
    nodes = list(_walk(plan))
    known = {r.lower() for r in relations} if relations is not None else {t.name.lower() for t in spark.catalog.listTables()}
    known |= {str(named._1()).lower() for node, _ in nodes if _class(node) == "UnresolvedWith" for named in _items(node.cteRelations())}
    allowed = harmless_functions(spark)
    for node, expressions in nodes:
        kind = _class(node)
        if kind not in _ASKING:
            raise Refused("Only questions can be asked here: SELECT, WITH, VALUES or EXPLAIN.")
        if kind == "UnresolvedRelation":
            name = _names(node.multipartIdentifier())
            if len(name) != 1 or name[0] not in known:
                raise Refused(f"There is no relation {'.'.join(name)} here.")
        used = [_names(node.name())] if kind == "UnresolvedTableValuedFunction" else []
        used += [_names(e.nameParts()) for e in expressions if _class(e) == "UnresolvedFunction"]
        used += [[str(e.name().funcName()).lower()] for e in expressions if _class(e) == "UnresolvedGenerator"]
        for name in used:
            if len(name) != 1 or name[0] not in allowed:
                raise Refused(f"The function {'.'.join(name)} can't be used here.")


def cell(value):
    """Numbers stay numbers, what no number can show is null, long text is clipped, bytes are described."""
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, (bytes, bytearray)):
        return f"⟨{len(value)} bytes⟩"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    text = str(value)
    return text if len(text) <= CELL_CHARACTERS else text[:CELL_CHARACTERS] + "…"


def ask(spark: SparkSession, sql: str, limit: int = DEFAULT_ROWS, seconds: float = SECONDS, relations: set[str] | None = None) -> Answer:
    """Run a question. One row beyond the limit is fetched, to see whether there are more.

    The question runs in a thread of its own, so that its time is up when it is up: the caller is
    told at the deadline, and the jobs are cancelled again and again until the thread has ended,
    since a cancel reaches only jobs that have begun. It is asked in a copy of the session.
    """
    check(spark, sql, relations)
    asked, context = copied(spark), spark.sparkContext
    limit = max(1, min(limit, ROW_CEILING))
    tag, began, done = f"ask-{uuid.uuid4().hex}", time.monotonic(), threading.Event()
    found: dict = {}

    def work() -> None:
        context.addJobTag(tag)
        try:
            df = asked.sql(sql).limit(limit + 1)
            if "BroadcastNestedLoopJoin" in df._jdf.queryExecution().executedPlan().toString():
                df = _stoppable(asked).sql(sql).limit(limit + 1)
            found["columns"], found["rows"] = df.columns, df.collect()
        except Exception as e:
            found["error"] = e
        finally:
            context.removeJobTag(tag)
            done.set()

    threading.Thread(target=work, daemon=True).start()
    if not done.wait(seconds):
        threading.Thread(target=_cancel, args=(context, tag, done), daemon=True).start()
        raise Refused(f"Stopped after {seconds:g} seconds.")
    error = found.get("error")
    if isinstance(error, PySparkException):
        raise Refused(str(error).splitlines()[0])
    if error is not None:
        raise error
    shown = [[cell(v) for v in r] for r in found["rows"][:limit]]
    return Answer(found["columns"], shown, len(found["rows"]) > limit, int((time.monotonic() - began) * 1000))


def copied(spark: SparkSession) -> SparkSession:
    """A copy of the session with its views and settings; what it is given stays its own."""
    return SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())


def _stoppable(copy: SparkSession) -> SparkSession:
    """The session, changed so that a running task can always be stopped.

    The loop of a broadcast nested-loop join looks for a kill only between batches of its outer
    rows, minutes apart if the inner side is large; a cartesian product looks at every row. Equal
    keys are still broadcast by adaptive execution.
    """
    small = copy.conf.get("spark.sql.autoBroadcastJoinThreshold")
    copy.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", small)
    copy.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return copy


def _cancel(context: SparkContext, tag: str, done: threading.Event) -> None:
    # by a job tag of the context: a session's own tags can only be interrupted from the thread that set them
    while not done.is_set():
        try:
            context.cancelJobsWithTag(tag)
        except Exception:  # the session ended before the question
            return
        done.wait(0.5)


def kinds(answer: Answer) -> list[str]:
    """number, text or empty: what each column turned out to hold."""
    out = []
    for i in range(len(answer.columns)):
        values = [r[i] for r in answer.rows if r[i] is not None]
        numeric = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
        out.append("empty" if not values else "number" if numeric else "text")
    return out


def nice_scale(low: float, high: float, count: int = 5) -> list[float]:
    """Round ticks that cover a range, in steps of 1, 2 or 5 times a power of ten.

    A single value gets half of itself as room on both sides; a range that is not finite is 0 to 1.
    """
    low, high = min(low, high), max(low, high)
    if not (math.isfinite(low) and math.isfinite(high)):
        return [0.0, 1.0]
    if low == high:
        room = abs(low) / 2 or 1
        low, high = low - room, high + room
    raw = (high - low) / max(count, 1)
    power = 10.0 ** math.floor(math.log10(raw))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw * (1 - 1e-12))
    first = math.floor(low / step)
    last = math.ceil(high / step)
    return [float(f"{i * step:.12g}") for i in range(first, last + 1)]


@dataclass(frozen=True)
class Axes:
    """Columns, by position, that a chart of an answer sets against each other."""

    x: int
    y: int
    shape: str


@dataclass(frozen=True)
class Recipe:
    """A question that comes with the workbench, and the names of the columns worth drawing."""

    name: str
    about: str
    sql: str
    x: str | None = None
    y: str | None = None
    shape: str = "bar"


def everything(view: str) -> Recipe:
    """All columns of a view, fifty rows deep."""
    quoted = view.replace("`", "``")
    return Recipe(view, f"Every column of {view}.", f"SELECT * FROM `{quoted}` LIMIT 50")


def default_axes(answer: Answer) -> Axes | None:
    """What rows are of against what is counted: the first column without numbers, the first with.

    Numbers alone are a relationship of the first two; one column stands for its own labels.
    """
    told = kinds(answer)
    numbers = [i for i, k in enumerate(told) if k == "number"]
    if not numbers:
        return None
    labels = [i for i, k in enumerate(told) if k != "number"]
    if labels:
        return Axes(labels[0], numbers[0], "bar")
    return Axes(numbers[0], numbers[1], "scatter") if len(numbers) > 1 else Axes(numbers[0], numbers[0], "bar")


def recipe_axes(answer: Answer, recipe: Recipe | None) -> Axes | None:
    """A recipe's axes by name; none where the question was edited and a name is gone."""
    if recipe is None or recipe.x not in answer.columns or recipe.y not in answer.columns:
        return None
    return Axes(answer.columns.index(recipe.x), answer.columns.index(recipe.y), recipe.shape)


@dataclass
class Chart:
    """What to draw: (row, x, y) points in data coordinates, ticks of both axes, rows left out."""

    points: list[tuple[int, float, float]]
    x_ticks: list[tuple[float, str]]
    y_ticks: list[float]
    skipped: int


def chart(answer: Answer, axes: Axes) -> Chart | None:
    """Plan of a chart; rows whose value is no number are counted, not drawn, and none at all is None.

    Bars stand on zero and keep the answer's order. Lines and scatters against numbers are sorted
    by them. Labels are thinned evenly to LABELS, the last always kept, and clipped.
    """
    value = lambda r: r[axes.y]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    rows = [(i, r) for i, r in enumerate(answer.rows) if number(value(r))]
    if not rows:
        return None
    low, high = min(value(r) for _, r in rows), max(value(r) for _, r in rows)
    y_ticks = nice_scale(min(0, low), max(0, high)) if axes.shape == "bar" else nice_scale(low, high)
    skipped = len(answer.rows) - len(rows)
    if axes.shape != "bar" and all(number(r[axes.x]) for _, r in rows):
        rows.sort(key=lambda ir: ir[1][axes.x])
        scale = nice_scale(rows[0][1][axes.x], rows[-1][1][axes.x])
        return Chart([(i, r[axes.x], value(r)) for i, r in rows], [(t, f"{t:g}") for t in scale], y_ticks, skipped)
    every = math.ceil(len(rows) / LABELS)
    label = lambda r: "—" if r[axes.x] is None else str(r[axes.x])
    clipped = [t if len(t) <= LABEL_CHARACTERS else t[: LABEL_CHARACTERS - 1] + "…" for t in (label(r) for _, r in rows)]
    ticks = [(k + 0.5, t) for k, t in enumerate(clipped) if k % every == 0 or k == len(rows) - 1]
    return Chart([(i, k + 0.5, value(r)) for k, (i, r) in enumerate(rows)], ticks, y_ticks, skipped)
