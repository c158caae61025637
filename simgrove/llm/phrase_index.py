"""Benchmark decontamination by a distributed positional inverted index.

The index is a stored table of postings: term, document, position and the words around it. It holds the terms that some
benchmark window needs: the two rarest of each window by their counts over all documents. A window's candidates are the
starts that both lists give once each is moved by its term's offset; the posting's own words then confirm the whole phrase.
Everything is DataFrame work: no Python runs on the executors.

Defined results: a null or wordless text has no words, no hits; rows with equal (id, text) get equal results and each keeps its
row; equal ids with other texts are judged apart; an empty table gives an empty result, an empty benchmark no hits; repeated
items each count by their own item_id, a null item_id is left out of the list of items but its words are hit; other columns of either table are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import ascii_lower, broadcast_if_small, stored

#: a window table or a term list of up to so many rows (about 200 bytes each) is broadcast; a larger one is joined by shuffle
BROADCAST_ROWS = 200_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the A-Z-lowered text: runs of digits, a-z and everything beyond ASCII."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAKS), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each different window: phrase, words, n; with the ids of the items that have it."""
    w = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("phrase_words"))
    return w.groupBy("phrase_words").agg(F.collect_set("item_id").alias("items")).withColumn("n", F.size("phrase_words"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, text: str) -> DataFrame:
    """Occurrences of the given terms over all documents."""
    tokens = docs.select(F.explode(words(F.col(text))).alias("term"))
    return tokens.join(broadcast_if_small(terms, n_terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, window: int, doc_id: str, text: str) -> DataFrame:
    """Postings (term, doc_id, text_key, n_words, pos from 1, before, around) of the given terms; the term '' has one posting for each document.

    around: the words from `before` places before the position to window - 1 places after it.
    """
    with_head = F.concat(F.array(F.lit("")), F.col("w"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), words(F.col(text)).alias("w"))
    d = d.select("doc_id", "text_key", "w", F.posexplode(with_head).alias("pos", "term"))
    terms = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string"))
    d = d.join(broadcast_if_small(terms, n_terms, BROADCAST_ROWS), "term")
    before = F.least(F.col("pos") - 1, F.lit(window - 1))
    around = F.when(F.col("term") != "", F.slice("w", F.greatest(F.col("pos") - before, F.lit(1)), before + F.lit(window)))
    return d.select("term", "doc_id", "text_key", F.size("w").alias("n_words"), "pos", before.alias("before"), around.alias("around"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(documents, matches): a row for each input document with n_words; a row for each occurrence of a window: doc_id, text_key, start (from 1), n, items."""
    wins = stored(item_windows(benchmark, window, item_id, item_text), "windows")
    by_term = wins.select("phrase_words", "n", F.posexplode("phrase_words").alias("off", "term"))
    terms = stored(by_term.select("term").distinct(), "terms")
    n_windows, n_terms = wins.count(), terms.count()
    freq = stored(term_counts(docs, terms, n_terms, text), "freq")
    # a window with a term that no document has can't occur; the inner join keeps its other terms, so they are counted
    ranked = by_term.join(broadcast_if_small(freq, n_terms, BROADCAST_ROWS), "term").groupBy("phrase_words", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "off", "term"))).alias("t"))
    ranked = ranked.filter(F.size("t") == F.col("n")).select("phrase_words", "n", F.col("t")[0].alias("one"), F.when(F.col("n") > 1, F.col("t")[1]).alias("two"))
    plan = stored(ranked.join(wins.select("phrase_words", "items"), "phrase_words"), "plan")
    rare = plan.select(F.explode(F.array("one.term", "two.term")).alias("term")).filter("term is not null").distinct()
    index = stored(build_index(docs, rare, n_terms, window, doc_id, text), "postings")

    first = broadcast_if_small(plan.withColumn("term", F.col("one.term")), n_windows, BROADCAST_ROWS)
    cand = index.filter("term <> ''").join(first, "term").withColumn("start", F.col("pos") - F.col("one.off"))
    exact = F.slice("around", F.greatest(F.col("before") + 1 - F.col("one.off"), F.lit(1)), F.col("n")) == F.col("phrase_words")
    cand = cand.filter((F.col("one.off") <= F.col("before")) & (F.col("start") >= 1) & (F.col("start") + F.col("n") - 1 <= F.col("n_words")))
    # lists of the second rarest term, moved by its offset; a posting row is one (term, document, position)
    second = broadcast_if_small(plan.filter("two is not null").select("phrase_words", F.col("two.term").alias("term"), F.col("two.off").alias("off2")), n_windows, BROADCAST_ROWS)
    moved = index.filter("term <> ''").join(second, "term").select(F.col("doc_id").alias("d2"), F.col("text_key").alias("k2"), (F.col("pos") - F.col("off2")).alias("s2"), F.xxhash64("phrase_words").alias("p2"))
    single, double = cand.filter("two is null"), cand.filter("two is not null").withColumn("p1", F.xxhash64("phrase_words"))
    both = double.join(moved, (F.col("text_key") == F.col("k2")) & (F.col("start") == F.col("s2")) & (F.col("p1") == F.col("p2")) & F.col("doc_id").eqNullSafe(F.col("d2")), "left_semi").drop("p1")
    found = both.unionByName(single).filter(exact).select("doc_id", "text_key", "start", "n", "items")
    heads = index.filter("term = ''").select("doc_id", "text_key", "n_words")
    return heads, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """A row for each document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    heads, found = phrase_matches(docs, benchmark, window, doc_id, text, item_text, item_id)
    # equal rows are in the index once each: distinct matches first
    found = stored(found.distinct(), "matches")
    hits = found.select("doc_id", "text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p")).distinct()
    hits = hits.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select("doc_id", "text_key", F.explode("items").alias("item")).distinct()
    items = items.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    both = hits.join(items.withColumnsRenamed({"doc_id": "di", "text_key": "ki"}), (F.col("text_key") == F.col("ki")) & F.col("doc_id").eqNullSafe(F.col("di")), "left").select(F.col("doc_id").alias("dh"), F.col("text_key").alias("kh"), "n_hit", "items")
    none = F.array().cast("array<string>")
    out = heads.join(both, (F.col("text_key") == F.col("kh")) & F.col("doc_id").eqNullSafe(F.col("dh")), "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", none)})
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_key",
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of which every word stands within window + slack places of a document, in any order: doc_id, text_key, pos, phrase_words.

    Found from the same kind of index: the rarest term's postings with `window + slack` words around them.
    """
    wins = stored(item_windows(benchmark, window), "windows")
    by_term = wins.select("phrase_words", F.posexplode("phrase_words").alias("off", "term"))
    terms = stored(by_term.select("term").distinct(), "terms")
    n_terms, n_windows = terms.count(), wins.count()
    freq = term_counts(docs, terms, n_terms, text)
    plan = by_term.join(freq, "term", "left").groupBy("phrase_words").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)), "off", "term")).alias("one"))
    plan = stored(plan.select("phrase_words", F.col("one.term").alias("term")), "plan")
    span = window + slack
    index = stored(build_index(docs, plan.select("term").distinct(), n_terms, span, doc_id, text), "postings")
    c = index.filter("term <> ''").join(broadcast_if_small(plan, n_windows, BROADCAST_ROWS), "term")
    size = F.size("around")
    spans = F.transform(F.sequence(F.lit(1), F.greatest(size - F.lit(span - 1), F.lit(1))), lambda i: F.slice("around", i, span))
    near = F.exists(spans, lambda s: (F.size(F.array_except("phrase_words", s)) == 0) & F.array_contains(s, F.col("term")))
    return c.filter(near).select("doc_id", "text_key", "pos", "phrase_words")


ORACLE = r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
win as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i+least(len(w),10)-1], ' ') p from (select item_id, w, unnest(range(1, greatest(len(w)-9, 1)+1)) i from b where len(w) > 0)),
lens as (select distinct n from win),
dw as (select rid, i, n, array_to_string(w[i:i+n-1], ' ') p from (select rid, w, n, unnest(range(1, len(w)-n+2)) i from d, lens where len(w) >= n)),
m as (select dw.rid, dw.i, dw.n, win.item_id from dw join win on dw.n = win.n and dw.p = win.p),
h as (select rid, count(distinct pos) n_hit from (select rid, unnest(range(i, i+n)) pos from (select distinct rid, i, n from m)) group by rid),
it as (select rid, count(*) n_items, string_agg(s, ',' order by s) l from (select distinct rid, item_id::varchar s from m) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (rid) left join it using (rid)
"""
