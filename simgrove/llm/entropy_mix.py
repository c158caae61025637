"""Mixing sources to target weights by entropy balancing.

Targets share out the words of all documents by source weight, each at most CAP times its source's own words. Within a source the
rates r stay as near to 1 as relative entropy allows, subject to sum(r * size) = target and 0 <= r <= CAP. The solution is an
exponential tilt, r = min(CAP, exp(lam * size / mean size)), whose one multiplier for each source is the root of the convex dual's
gradient: safeguarded Newton steps, one distributed aggregate over the (source, size, count) histogram each. Rates are integers in
units of 2**-20 and sums are decimals, so results don't depend on the order of addition and reruns agree.

Rates become whole copies by systematic rounding along documents ordered by size: running sums of rates are cut at whole numbers.
The running sums are put together from small groups (source, size class, hash of the id), so that no task sees a whole source. Of
OFFSETS starting points of the cut, each source takes the one whose words come nearest its target.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents without words get rate 1 and take
0 words; repeated rows each get copies of their own; a very long text is one row of its source; without any words all targets are 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simgrove.llm.common import broadcast_if_small, discard, fresh, stored

CAP, UNIT, OFFSETS, CYCLE = 3, 1 << 20, 32, 3
STEPS = 60
#: tables of one row a source are broadcast up to so many counted rows; beyond, the planner's shuffled join stays
BROADCAST_ROWS = 100_000
SPACES = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: joins and windows treat the null source as one source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def targets(sources: DataFrame, cap: int = CAP, cycle: int = CYCLE) -> DataFrame:
    """sources (key, source, source_size) with weight and target.

    Sources in the order of cap * size / weight: those that the shared level reaches are full, and they are a prefix of that order.
    """
    everything = W.partitionBy()
    s = sources.withColumn("weight", (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    by_fill = everything.orderBy(F.col("source_size") * float(cap) / F.col("weight"), "key")
    earlier = by_fill.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
    s = s.withColumns({"full_before": F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * cap, "weights_before": F.coalesce(F.sum("weight").over(earlier), F.lit(0))})
    s = s.withColumn("full", (F.col("total") - F.col("full_before")) * F.col("weight").cast("double") / (F.col("weights") - F.col("weights_before")) >= F.col("source_size") * float(cap))
    s = s.withColumns({"full_size": F.sum(F.when(F.col("full"), F.col("source_size") * cap).otherwise(0)).over(everything), "full_weight": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything)})
    level = (F.col("total") - F.col("full_size")) * F.col("weight") / (F.col("weights") - F.col("full_weight"))
    return s.select("key", "source", "source_size", "weight", F.when(F.col("full"), F.col("source_size") * float(cap)).otherwise(level).cast("double").alias("target"))


def rate(lam: Column, size: Column, mean: Column, cap: int = CAP) -> Column:
    """The tilted rate in units of 2**-20."""
    return F.floor(F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(50.0)))) * UNIT + 0.5).cast("long")


def solve(hist: DataFrame, srcs: DataFrame, cap: int = CAP) -> DataFrame:
    """The multiplier of each source: key, lam, mean, target. hist: key, size (> 0), n."""
    span = hist.groupBy("key").agg(F.min("size").alias("least"), F.sum("n").alias("docs"))
    state = srcs.join(span, "key").select(
        "key", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(False).alias("done"),
        (-60.0 * F.col("source_size") / F.col("docs") / F.col("least")).alias("lo"), (2.0 * F.col("source_size") / F.col("docs") / F.col("least")).alias("hi"),
    )
    state = stored(state, "state")
    sources = state.count()
    for _ in range(STEPS):
        r = rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        big = lambda c: c.cast("decimal(38,0)")
        h = hist.join(broadcast_if_small(state.select("key", "lam", "mean"), sources, BROADCAST_ROWS), "key").withColumn("r", r)
        sums = h.groupBy("key").agg(
            F.sum(big(F.col("r") * F.col("size")) * big(F.col("n"))).alias("got"),
            F.sum(F.when(F.col("r") < cap * UNIT, big(F.col("r") * F.col("size")) * big(F.col("n") * F.col("size"))).otherwise(big(F.lit(0)))).alias("slope"),
        )
        s = state.join(sums, "key")
        g = F.col("got").cast("double") / UNIT - F.col("target")
        slope = F.col("slope").cast("double") / UNIT / F.col("mean")
        s = s.withColumns({"g": g, "slope_": slope})
        s = s.withColumns({"lo": F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - F.col("g") / F.col("slope_")
        inside = (F.col("slope_") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        s = s.withColumns({"next": F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)})
        close = (F.abs(F.col("g")) <= F.greatest(F.lit(0.25), F.col("target") * 1e-7)) | (F.col("hi") - F.col("lo") <= 1e-12)
        s = s.select("key", "target", "mean", F.when(F.col("done") | close, F.col("lam")).otherwise(F.col("next")).alias("lam"), (F.col("done") | close).alias("done"), "lo", "hi")
        before, state = state, stored(s, "state")
        discard(before)
        if state.filter("not done").isEmpty():
            return state
    raise RuntimeError(f"the dual has not been solved in {STEPS} steps")


def mix(docs: DataFrame, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, copies, rate, text_key, source_key."""
    d = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("text_key"))
    d = stored(d, "sizes")
    hist = stored(d.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    srcs = stored(targets(hist.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap), "targets")
    lams = solve(hist.filter("size > 0"), srcs, cap)
    # distinct sizes are few beside documents: rates are joined once for each (source, size)
    plan, sources = srcs.join(lams.select("key", "lam", "mean"), "key", "left"), srcs.count()
    r = F.when(F.col("target") >= F.col("source_size") * float(cap), F.lit(cap * UNIT)).otherwise(rate(F.col("lam"), F.col("size"), F.col("mean"), cap))
    d = d.join(broadcast_if_small(plan.drop("source"), sources, BROADCAST_ROWS), "key").withColumn("r", F.when(F.col("size") > 0, r).otherwise(F.lit(UNIT)).cast("long"))
    d = d.withColumns({"class": F.floor(F.log2(F.greatest("size", F.lit(1))) * 8).cast("int"), "part": F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(64)).cast("int")})
    d = stored(d.select("doc_id", "text_key", "key", "size", "source_size", "target", "r", "class", "part"), "rates")
    group = ["key", "class", "part"]
    groups = d.groupBy(*group).agg(F.sum("r").alias("r"))
    before = groups.withColumn("before", F.sum("r").over(W.partitionBy("key").orderBy("class", "part")) - F.col("r")).drop("r")
    run = F.sum("r").over(W.partitionBy(*group).orderBy("size", F.col("doc_id").asc_nulls_last(), "text_key").rowsBetween(W.unboundedPreceding, 0))
    d = stored(d.withColumn("run", run).join(before, group).withColumn("run", F.col("run") + F.col("before")), "running")

    def copies(start: Column) -> Column:
        """Whole numbers that the running sum passes within this document's rate."""
        return F.floor((F.col("run") + start) / UNIT) - F.floor((F.col("run") - F.col("r") + start) / UNIT)

    starts = [UNIT * (2 * i + 1) // (2 * OFFSETS) for i in range(OFFSETS)]
    words = d.groupBy("key").agg(*[F.sum(copies(F.lit(s)) * F.col("size")).alias(f"w{i}") for i, s in enumerate(starts)], F.first("target").alias("target"))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{i}") - F.col("target")), F.lit(s)) for i, s in enumerate(starts)]))[F.lit("col2")]
    d = d.join(broadcast_if_small(words.select("key", best.alias("start")), sources, BROADCAST_ROWS), "key").withColumn("copies", F.least(copies(F.col("start")), F.lit(cap)).cast("long"))
    return d.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", (F.col("r") / UNIT).alias("rate"), "text_key", F.col("key").alias("source_key"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix has them: each row as many times as it has copies, all columns kept. Rows equal in id, text and source stand for one another."""
    own = ["mix_id", "mix_text", "mix_source", "mix_nth", "mix_copies", "mix_copy"]
    m_id, m_text, m_source, m_nth, m_copies, m_copy = (fresh(x, docs) for x in own)
    key, source, nth = (fresh(x, docs) for x in ("own_text", "own_source", "own_nth"))
    taken = mix(docs).select(F.col("doc_id").alias(m_id), F.col("text_key").alias(m_text), F.col("source_key").alias(m_source), F.col("copies").alias(m_copies))
    taken = taken.withColumn(m_nth, F.row_number().over(W.partitionBy(m_id, m_text, m_source).orderBy(F.desc(m_copies)))).filter(F.col(m_copies) > 0)
    d = docs.withColumns({key: F.xxhash64("text"), source: source_key(F.col("source"))})
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    d = d.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", key, source).orderBy(order)))
    d = d.join(taken, F.col("doc_id").eqNullSafe(F.col(m_id)) & (F.col(key) == F.col(m_text)) & (F.col(source) == F.col(m_source)) & (F.col(nth) == F.col(m_nth)))
    return d.withColumn(m_copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(m_copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
