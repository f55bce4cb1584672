"""Chunks, keywords, question intent, vector search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import patterns as fixed
from tidemark.functions.similarity import words
from tidemark.operators.matching import best_ngram_match
from tidemark.plans.nearest import nearest
from tidemark.session import settle


# ---- chunks ----

def chunk(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed windows of ``size`` characters, each starting ``size - overlap`` after the last."""
    step = size - overlap
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    cut = docs.filter(F.length(text) > 0).select(F.col(key), F.col(text), F.posexplode(starts).alias("chunk_id", "start"))
    return cut.select(key, F.col("chunk_id").cast("long").alias("chunk_id"), F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


def _stepped(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters of a text without marks, cut once into steps."""
    step = size - overlap
    steps = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    last = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.array_join(F.slice(steps, i, -(-size // step)), ""), 1, size))


def _merged(text: Column, size: int, overlap: int, marks: tuple[str, ...]) -> Column:
    """Chunks of a text cut before each first mark; a piece of ``size`` or more is cut at the next marks.

    A fold over the pieces: the text of the open window, its length, and the chunks closed
    so far. When a piece does not fit, the window closes and keeps its last pieces, as many
    as the overlap and the new piece leave room for. A window starts at a mark or at the
    start of the text, so cutting it again gives its pieces.
    """
    if not marks:
        return _stepped(text, size, overlap)
    mark, finer = marks[0], marks[1:]
    none = F.array().cast("array<string>")

    def pieces(whole: Column) -> Column:
        cut = F.transform(F.split(whole, mark, -1), lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.lit(mark), piece)))
        return F.filter(cut, lambda piece: piece != "")

    def state(window: Column, total: Column, out: Column) -> Column:
        return F.struct(window.alias("window"), total.cast("int").alias("total"), out.alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(acc["total"] > 0, F.array_append(acc["out"], acc["window"])).otherwise(acc["out"])

    def add(acc: Column, piece: Column) -> Column:
        n = F.length(piece)
        room = F.least(F.lit(overlap), size - n)
        kept = F.aggregate(pieces(acc["window"]), acc["total"], lambda left, old: F.when(left > room, left - F.length(old)).otherwise(left))
        moved = F.transform(F.array(kept), lambda left: state(
            F.concat(F.substring(acc["window"], acc["total"] - left + 1, left), piece), left + n, closed(acc)))[0]
        return (F.when(n >= size, state(F.lit(""), F.lit(0), F.concat(closed(acc), _merged(piece, size, overlap, finer))))
                .when(acc["total"] + n > size, moved)
                .otherwise(state(F.concat(acc["window"], piece), acc["total"] + n, acc["out"])))

    return F.aggregate(pieces(text), state(F.lit(""), F.lit(0), none), add, closed)


def chunk_by_marks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_id, chunk): chunks cut before paragraph ends, line ends and blanks where possible.

    A mark belongs to the piece that it starts and counts in its length; white space at
    both ends of a chunk goes, and so does a chunk of nothing else. Lengths are in
    characters. Null and empty texts give no row; every row of a repeated key is cut by
    itself, its chunks numbered from 0.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    ends = rf"\A{fixed.WHITE_SPACE}+|{fixed.WHITE_SPACE}+\z"
    chunks = F.transform(_merged(F.col(text), size, overlap, ("\n\n", "\n", " ")), lambda c: F.regexp_replace(c, ends, ""))
    # The outer form: the inner one adds a filter that would cut every text again.
    return (docs.select(F.col(key), F.posexplode_outer(F.filter(chunks, lambda c: c != "")).alias("chunk_id", "chunk"))
            .filter("chunk IS NOT NULL").select(key, F.col("chunk_id").cast("long").alias("chunk_id"), "chunk"))


# ---- term weights ----

#: Terms whose weights go to every task, and the longest of them; the rows of all others are joined.
HOT_TERMS = 100_000
HOT_LENGTH = 64


def term_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, weight): term counts times smoothed idf, each document scaled to length 1.

    Texts, not their terms, are shuffled to be counted. Most rows belong to the most frequent
    terms, whose idf is a bounded table; only the rows of rarer terms meet theirs in a shuffle.
    """
    n = float(docs.count())
    placed = docs.select(F.col(key), F.col(text)).repartition(F.col(key))
    counts = settle(placed.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")), "counts")
    found = settle(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    top = F.broadcast(settle(found.filter(F.length("term") <= HOT_LENGTH).orderBy(F.col("df").desc(), "term").limit(HOT_TERMS).select("term"), "hot"))
    # at most HOT_TERMS short rows
    hot = F.broadcast(found.join(top, "term", "left_semi"))
    rare = counts.join(top, "term", "left_anti").join(found.join(top, "term", "left_anti"), "term")
    # counts travel back to their document, weights are computed there
    rows = counts.join(hot, "term").unionByName(rare).repartition(F.col(key))
    weighted = rows.withColumn("w", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    per_doc = Window.partitionBy(key)  # the terms of one document
    return weighted.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_doc))).select(key, "term", "tf", "weight")


def keyword_tags(docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """The k heaviest terms per document; ties in term order."""
    order = Window.partitionBy(key).orderBy(F.round("weight", 9).desc(), F.col("term"))
    return (term_weights(docs, key, text).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
            .select(key, "position", "term", "weight"))


# ---- question intent ----

def _hits(text: Column, patterns: list[str]) -> Column:
    return sum([text.rlike("(?d)" + p).cast("int") for p in patterns], F.lit(0))


def _mentions(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def classify_intent(df: DataFrame, text: str, has_tables: bool = True, has_docs: bool = True) -> DataFrame:
    """Adds sql_score, analysis_score, document_score, intent and confidence."""
    low = F.trim(F.lower(F.col(text)))
    asks, retrieves = _mentions(low, fixed.QUESTION_WORDS), _mentions(low, fixed.RETRIEVAL_WORDS)
    boost = F.when(asks & _mentions(low, fixed.INDICATOR_WORDS), 2).when(asks & retrieves, 2).otherwise(0)
    sql = _hits(low, fixed.SQL_PATTERNS)
    sql = F.when(retrieves & ~_mentions(low, fixed.EXPLICIT_SQL), F.greatest(sql - 2, F.lit(0))).otherwise(sql)
    analysis = _hits(low, fixed.ANALYSIS_PATTERNS) + boost + F.when(retrieves, 1).otherwise(0)
    scored = df.withColumns({"sql_score": sql.cast("long"), "analysis_score": analysis.cast("long"),
                             "document_score": _hits(low, fixed.DOCUMENT_PATTERNS).cast("long")})
    s, a, d = F.col("sql_score"), F.col("analysis_score"), F.col("document_score")
    cases = [((s > 0) & (s >= a), "sql_generation", F.least(F.lit(0.9), 0.6 + s * 0.1)),
             ((a > 0) & F.lit(has_tables), "data_analysis", F.least(F.lit(0.9), 0.7 + a * 0.05)),
             ((d > 0) & F.lit(has_docs), "document_search", F.least(F.lit(0.9), 0.8 + d * 0.05)),
             (F.lit(has_tables) & asks, "data_analysis", F.lit(0.6))]
    intent, confidence = F.lit("general_question"), F.lit(0.5)
    for test, name, level in reversed(cases):
        intent, confidence = F.when(test, name).otherwise(intent), F.when(test, level).otherwise(confidence)
    return scored.withColumn("intent", intent).withColumn("confidence", confidence)


def intent_matches(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per question and matching pattern: family and pattern number."""
    low = F.trim(F.lower(F.col(text)))
    families = {"sql": fixed.SQL_PATTERNS, "analysis": fixed.ANALYSIS_PATTERNS, "document": fixed.DOCUMENT_PATTERNS}
    hits = [F.when(low.rlike("(?d)" + p), F.struct(F.lit(f).alias("family"), F.lit(i).cast("long").alias("pattern")))
            for f, ps in families.items() for i, p in enumerate(ps)]
    return df.select(*keys, F.inline(F.array_compact(F.array(*hits))))


# ---- vectors ----

def unit(vec: Column) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    values = vec.cast("array<double>")
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(values, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def vector_topk(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, vec: str, k: int = 5,
                min_score: float | None = None, skip_same_id: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k corpus vectors with the highest cosine, exact.

    For unit vectors the order by cosine is the order by distance, so the pivot
    search applies.
    """
    q = queries.select(F.col(query_key).alias("query_id"), unit(F.col(vec)).alias("vec"))
    c = corpus.select(F.col(key).alias("id"), unit(F.col(vec)).alias("vec"))
    hits = nearest(q, c, k, skip_same_id).select("query_id", "rank", "id", (1 - F.col("distance") * F.col("distance") / 2).alias("score"))
    return hits.filter(F.col("score") >= min_score) if min_score is not None else hits


def vector_mmr(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, vec: str, k: int = 5,
               balance: float = 0.5, fetch: int = 20, min_score: float | None = None) -> DataFrame:
    """Maximal marginal relevance (Carbonell & Goldstein 1998) over the ``fetch`` best hits per query."""
    hits = vector_topk(queries, corpus, query_key, key, vec, fetch, min_score)
    vectors = corpus.select(F.col(key).alias("id"), unit(F.col(vec)).alias("vec"))
    rows = hits.join(vectors, "id").select("query_id", "id", "score", "vec")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        m = np.vstack(pdf["vec"].to_numpy())
        alike = m @ m.T
        relevance = pdf["score"].to_numpy()
        chosen: list[int] = []
        rest = list(range(len(pdf)))
        while rest and len(chosen) < k:
            gain = [balance * relevance[i] - (1 - balance) * (alike[i, chosen].max() if chosen else 0.0) for i in rest]
            best = rest[int(np.argmax(np.round(gain, 12)))]
            chosen.append(best)
            rest.remove(best)
        out = pdf.loc[chosen, ["query_id", "id", "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype="int64"))

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("query_id").applyInPandas(  # at most ``fetch`` rows per group
        pick, f"query_id {types['query_id']}, id {types['id']}, score double, rank long")


def search_with_fallback(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, vec: str, text: str,
                         k: int = 5, min_score: float = 0.3, text_threshold: float = 0.5) -> DataFrame:
    """Vector hits; a query without any is asked again with its best n-gram text match.

    Both sides carry a vector and a text column.
    """
    direct = settle(vector_topk(queries, corpus, query_key, key, vec, k, min_score), "direct").withColumn("via", F.lit("vector"))
    missed = settle(queries.join(direct.select(F.col("query_id").alias(query_key)).distinct(), query_key, "left_anti")
                    .select(query_key, text), "missed")
    matched = best_ngram_match(missed, corpus, text, text, text_threshold).select(
        F.col("left_value").alias("_q"), F.col("right_value").alias("_c"))
    heads = corpus.groupBy(F.col(text).alias("_c")).agg(F.min_by(F.col(vec), F.col(key)).alias("_v"))
    again = settle(missed.select(query_key, F.col(text).alias("_q")).join(matched, "_q").join(heads, "_c")
                   .select(query_key, F.col("_v").alias(vec)), "again")
    second = vector_topk(again, corpus, query_key, key, vec, k, min_score).withColumn("via", F.lit("text"))
    return direct.unionByName(second)
