"""Equations among metrics, solved to a fixpoint as column expressions over one wide row for each key.

In each pass an equation with exactly one unknown proposes a value for it from the state before the pass. Where the
proposals for a metric agree within a tolerance, that of the lowest code is taken; else none is, and the row is flagged.
The passes are unrolled: a pass that finds anything settles at least one equation, so as many as equations suffice.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.periods import close


@dataclass(frozen=True)
class Equation:
    """kind 'sum': total = parts added, less those of `minus`; kind 'ratio': total = parts[0] / parts[1]."""

    code: str
    kind: str
    total: str
    parts: tuple[str, ...]
    minus: tuple[str, ...] = ()

    @property
    def operands(self) -> tuple[str, ...]:
        return (self.total, *self.parts, *self.minus)

    def display(self) -> str:
        if self.kind == "ratio":
            return f"{self.parts[0]} / {self.parts[1]}"
        return " + ".join(self.parts) + "".join(f" - {m}" for m in self.minus)

    def value_sql(self, metric: str) -> str:
        """The metric from the other operands; null where one is null or a divisor is zero."""
        if self.kind == "sum":
            added, taken = [p for p in self.parts if p != metric], [m for m in self.minus if m != metric]
            if metric == self.total:
                return " - ".join([" + ".join(added), *taken])
            if metric in self.parts:
                return " + ".join([" - ".join([self.total, *added]), *taken])
            return " - ".join([" + ".join(added), *taken, self.total])
        over, under = self.parts
        if metric == self.total:
            return f"try_divide({over}, {under})"
        return f"{self.total} * {under}" if metric == over else f"try_divide({over}, {self.total})"

    def value_of(self, metric: str) -> Column:
        return F.expr(self.value_sql(metric))


#: Qualities from the strongest to the weakest; an unknown one counts as the strongest.
QUALITIES = {"verified": 0, "preliminary": 1, "estimated": 2, "imputed": 3}

EQUATIONS = (
    Equation("cost_per_trip", "ratio", "cost_per_trip", ("operating_expenses", "ridership")),
    Equation("expense_split", "sum", "operating_expenses", ("farebox_revenue", "operating_deficit")),
    Equation("recovery_ratio", "ratio", "recovery_ratio", ("farebox_revenue", "operating_expenses")),
    Equation("trips_per_hour", "ratio", "trips_per_hour", ("ridership", "revenue_service_hours")),
)


#: The identities and ratios of an agency's statements and service figures, by code.
STATEMENT_EQUATIONS = (
    Equation("expense_revenue_subsidy", "sum", "operating_expenses", ("total_revenue_excluding_subsidy", "subsidy")),
    Equation("expense_components", "sum", "operating_expenses", ("labour_cost", "energy_fuel_cost", "materials_services_cost", "amortization", "other_operating_expenses")),
    Equation("earned_revenue_components", "sum", "total_revenue_excluding_subsidy", ("farebox_revenue", "other_revenue")),
    Equation("total_revenue_def", "sum", "total_revenue", ("total_revenue_excluding_subsidy", "subsidy")),
    Equation("annual_surplus_deficit_def", "sum", "annual_surplus_deficit", ("total_revenue",), ("total_expenses",)),
    Equation("average_fare_def", "ratio", "average_fare", ("farebox_revenue", "ridership")),
    Equation("cost_per_hour_def", "ratio", "cost_per_hour", ("operating_expenses", "revenue_service_hours")),
    Equation("cost_per_rider_def", "ratio", "cost_per_rider", ("operating_expenses", "ridership")),
    Equation("farebox_recovery_def", "ratio", "farebox_recovery_ratio", ("farebox_revenue", "operating_expenses")),
    Equation("subsidy_per_rider_def", "ratio", "subsidy_per_rider", ("subsidy", "ridership")),
    Equation("trips_per_revenue_hour_def", "ratio", "trips_per_revenue_hour", ("ridership", "revenue_service_hours")),
    Equation("net_debt_def", "sum", "net_debt", ("total_liabilities",), ("total_financial_assets",)),
    Equation("total_assets_identity", "sum", "total_assets", ("total_financial_assets", "total_non_financial_assets")),
    Equation("accumulated_surplus_identity", "sum", "accumulated_surplus", ("total_assets",), ("total_liabilities",)),
    Equation("debt_to_assets_def", "ratio", "debt_to_assets", ("total_liabilities", "total_assets")),
    Equation("net_debt_per_capita_def", "ratio", "net_debt_per_capita", ("net_debt", "service_area_population")),
    Equation("financial_assets_components", "sum", "total_financial_assets", ("cash_and_investments", "other_financial_assets")),
    Equation("liabilities_components", "sum", "total_liabilities", ("long_term_debt", "other_liabilities")),
    Equation("non_financial_assets_components", "sum", "total_non_financial_assets", ("tangible_capital_assets", "other_non_financial_assets")),
)
#: Attributes that are read but never solved for.
ATTRIBUTES = ("service_area_population",)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; on local masters without one it is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-ridgeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint in the shared folder, so that a loop's plan stays small."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder as a compressed table, for plans that read it several times."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pass(state: DataFrame, metrics: list[str], equations: tuple[Equation, ...], rel: float, weakness: bool = True) -> DataFrame:
    """The state after one pass over all equations; _moved tells whether a row found anything.

    Proposals, the first of them and their agreement are columns of their own, each computed once: written out in one
    another they would grow with the square of a metric's equations.
    """
    ordered = sorted(equations, key=lambda e: e.code)
    found = {m: {e: f"{m}__by_{e.code}" for e in ordered if m in e.operands} for m in metrics if m not in ATTRIBUTES}
    kept = [c for c in state.columns if c != "_moved"]
    s = state.selectExpr("*", *[f"CASE WHEN {m} IS NULL THEN {e.value_sql(m)} END AS {v}" for m, es in found.items() for e, v in es.items()])
    s = s.selectExpr("*", *[f"coalesce({', '.join(es.values())}) AS {m}__first" for m, es in found.items()])
    near = lambda a, b: f"coalesce(abs({a} - {b}) <= {rel}D * greatest(abs({a}), abs({b})), true)"
    s = s.selectExpr("*", *[" AND ".join([f"{m}__first IS NOT NULL", *(near(v, f"{m}__first") for v in es.values())]) + f" AS {m}__take" for m, es in found.items()])
    new = {}
    for m, es in found.items():
        case = lambda of, m=m, es=es: f"CASE WHEN NOT {m}__take THEN {of(None)} " + " ".join(f"WHEN {v} IS NOT NULL THEN {of(e)}" for e, v in es.items()) + " END"
        new[m] = f"if({m}__take, {m}__first, {m})"
        new[f"{m}__from"] = case(lambda e, m=m: f"'{e.code}'" if e else f"{m}__from")
        new[f"{m}__odd"] = f"{m}__first IS NOT NULL AND NOT {m}__take"
        if weakness:
            new[f"{m}__q"] = case(lambda e, m=m: f"greatest({', '.join(['0', '0', *(f'{o}__q' for o in e.operands if o != m)])})" if e else f"{m}__q")
    return s.selectExpr(*[f"{new[c]} AS {c}" if c in new else f"`{c}`" for c in kept], " OR ".join(f"{m}__take" for m in found) + " AS _moved")


def _cells(state: DataFrame, keys: list[str], metrics: list[str], weakness: bool = True) -> DataFrame:
    cells = [
        f"struct('{m}' AS metric, {m} AS value, {m}__from AS equation, {m}__odd AS conflict" + (f", {m}__q AS weakness" if weakness else "") + ")" for m in metrics if m not in ATTRIBUTES
    ]
    return state.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({', '.join(cells)}))").filter("value IS NOT NULL OR conflict")


def solve_all(wide: DataFrame, keys: list[str], equations: tuple[Equation, ...] = STATEMENT_EQUATIONS, rel: float = 0.02, quality: bool = False) -> DataFrame:
    """`fixpoint` for large catalogs: a pass at a time until none finds anything, however long the chain.

    (keys, metric, value, equation, conflict, weakness): with `quality`, columns metric__q of `wide` hold how weak each
    observed value is, and a solved one is as weak as the weakest operand that it came from.
    """
    metrics = [m for m in dict.fromkeys(m for e in equations for m in e.operands)]
    there = set(wide.columns)
    state = wide.selectExpr(*[f"`{k}`" for k in keys], *[x for m in metrics for x in (
        f"CAST({m if m in there else 'NULL'} AS DOUBLE) AS {m}", f"CAST({f'{m}__q' if quality and f'{m}__q' in there else '0'} AS INT) AS {m}__q",
        f"CAST(NULL AS STRING) AS {m}__from", f"false AS {m}__odd",
    )])
    settled = []
    while True:  # a row in which a pass finds nothing is done: the next pass takes up the others only
        state = settle(_pass(state, metrics, equations, rel))
        settled.append(state.filter("NOT _moved"))
        state = state.filter("_moved")
        if state.limit(1).count() == 0:
            break
    return _cells(reduce(DataFrame.unionByName, settled), keys, metrics)


def edges(solved: DataFrame, keys: list[str], equations: tuple[Equation, ...] = STATEMENT_EQUATIONS) -> DataFrame:
    """(keys, metric, equation, input): the lineage of solved values."""
    inputs = F.create_map(*[x for e in equations for x in (F.lit(e.code), F.array(*map(F.lit, e.operands)))])
    out = solved.filter("equation IS NOT NULL").select(*keys, "metric", "equation", F.explode(F.element_at(inputs, F.col("equation"))).alias("input"))
    return out.filter("input <> metric")


def recompute(values: DataFrame, keys: list[str], rated: tuple[str, ...], equations: tuple[Equation, ...] = STATEMENT_EQUATIONS) -> DataFrame:
    """Derived values of every key (such as agency, period, mode and scope), from its sourced ones.

    values: keys, metric, value, quality, cost_basis, derived. Values derived before are left out. Total-basis expenses are
    put on the operating basis by taking amortization off; where that is not published they stand, and what is derived in
    that key is tainted. Returns keys, metric, value, equation, quality (the weakest of the inputs'), comparable (rated and
    not tainted).
    """
    metrics = list(dict.fromkeys(m for e in equations for m in e.operands))
    seed = values.filter(~F.col("derived") & F.col("metric").isin(*metrics))
    weakness = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for q, k in QUALITIES.items() for x in (q, k)]), F.col("quality")), F.lit(0))
    cell = lambda m, v: F.max(F.when(F.col("metric") == m, v))
    total = F.bool_or((F.col("metric") == "operating_expenses") & (F.col("cost_basis") == "psab_total"))
    wide = seed.groupBy(*keys).agg(F.coalesce(total, F.lit(False)).alias("_total"), *[f for m in metrics for f in (cell(m, F.col("value")).alias(m), cell(m, weakness).alias(f"{m}__q"))])
    less = F.col("_total") & F.col("amortization").isNotNull()
    wide = wide.withColumns({"operating_expenses": F.when(less, F.col("operating_expenses") - F.col("amortization")).otherwise(F.col("operating_expenses")), "_tainted": F.col("_total") & F.col("amortization").isNull(), "_less": less})
    wide = wide.withColumn("amortization", F.when(~F.col("_less"), F.col("amortization")))
    out = solve_all(wide, [*keys, "_tainted"], equations, quality=True).filter("equation IS NOT NULL")
    names = F.element_at(F.array(*[F.lit(q) for q, _ in sorted(QUALITIES.items(), key=lambda x: x[1])]), F.col("weakness") + 1)
    return out.select(*keys, "metric", "value", "equation", names.alias("quality"), (F.col("metric").isin(*rated) & ~F.col("_tainted")).alias("comparable"))


def fixpoint(wide: DataFrame, keys: list[str], equations: tuple[Equation, ...] = EQUATIONS, rel: float = 0.02) -> DataFrame:
    """(keys, metric, value, equation, conflict): each metric that has a value or a conflict; equation is null if observed."""
    metrics = list(dict.fromkeys(m for e in equations for m in e.operands))
    there = set(wide.columns)
    state = wide.selectExpr(*[f"`{k}`" for k in keys], *[x for m in metrics for x in (f"CAST({m if m in there else 'NULL'} AS DOUBLE) AS {m}", f"CAST(NULL AS STRING) AS {m}__from", f"false AS {m}__odd")])
    for _ in equations:
        state = _pass(state, metrics, equations, rel, weakness=False)
    return _cells(state, keys, metrics, weakness=False)


def failed_checks(wide: DataFrame, keys: list[str], equations: tuple[Equation, ...] = EQUATIONS, rel: float = 0.02) -> DataFrame:
    """(keys, equation, flag): equations whose operands are all there and do not hold within the tolerance."""
    usable = [e for e in equations if set(e.operands) <= set(wide.columns)]
    flags = [
        F.struct(F.lit(e.code).alias("equation"), F.when(~close(F.col(e.total), e.value_of(e.total), rel), "sum_mismatch" if e.kind == "sum" else "cross_source_disagreement").alias("flag"))
        for e in usable
    ]
    return wide.select(*keys, F.inline(F.array(*flags))).filter("flag IS NOT NULL")
