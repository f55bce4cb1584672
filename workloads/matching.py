"""Matching, spelling, retrieval, action-log and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import patterns as fixed
from tidemark.functions.similarity import words
from tidemark.operators import activity, matching as op, retrieval as ret
from workloads.common import ALL, each, longs, r, rounded, table, union

WORD = r"[\pL\pN_]{2,}"


def typos(s, d):
    """part names with one character left out; the place depends on the key."""
    part = table(s, d, "part")
    at = (F.col("p_partkey") % F.length("p_name")).cast("int")
    return part.select("p_partkey", F.concat(F.substring(F.col("p_name"), F.lit(1), at),
                                             F.substring(F.col("p_name"), at + 2, F.lit(100))).alias("typo"))


TYPOS = "typos AS (SELECT p_partkey, concat(substr(p_name, 1, (p_partkey % length(p_name))::int), substr(p_name, (p_partkey % length(p_name))::int + 2)) AS typo FROM part)"

LEADS = [
    "show me sql for the top customers", "how many orders", "what is the average price", "list all suppliers from europe",
    "generate sql statement", "explain the clause from the document", "according to the document", "hello there",
    "which nation has the highest revenue", "compare the regions", "find information about discounts", "write sql to count rows",
    "customers with open orders", "who are the largest suppliers", "give me sql query for parts", "search for returns",
    "when was this shipped", "display data where tax is zero", "calculate percentage of returns", "convert to sql please",
]


def questions(s, d):
    lead = F.element_at(F.array(*[F.lit(x) for x in LEADS]), ((F.col("conv_id") * 7 + F.col("turn")) % len(LEADS) + 1).cast("int"))
    return table(s, d, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.concat(lead, F.lit(" "), "text").alias("question"))


QUESTIONS = ("questions AS (SELECT conv_id, turn, concat((" + "[" + ", ".join(f"'{x}'" for x in LEADS) + "]"
             f")[(conv_id * 7 + turn) % {len(LEADS)} + 1], ' ', text) AS question, trim(lower(concat((" + "[" + ", ".join(f"'{x}'" for x in LEADS) + "]"
             f")[(conv_id * 7 + turn) % {len(LEADS)} + 1], ' ', text))) AS low FROM conversations WHERE role = 'user')")


def _hits(ps):
    return " + ".join(f"regexp_matches(low, '{p}')::bigint" for p in ps)


def _any(ws):
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")"


INTENT = f"""{QUESTIONS}, q1 AS (SELECT *, {_any(fixed.QUESTION_WORDS)} AS asks, {_any(fixed.RETRIEVAL_WORDS)} AS gets, {_any(fixed.INDICATOR_WORDS)} AS ind,
   {_any(fixed.EXPLICIT_SQL)} AS expl, {_hits(fixed.SQL_PATTERNS)} AS s0, {_hits(fixed.ANALYSIS_PATTERNS)} AS a0, {_hits(fixed.DOCUMENT_PATTERNS)} AS document_score FROM questions),
 q2 AS (SELECT *, CASE WHEN gets AND NOT expl THEN greatest(s0 - 2, 0) ELSE s0 END AS sql_score,
   a0 + CASE WHEN asks AND (ind OR gets) THEN 2 ELSE 0 END + CASE WHEN gets THEN 1 ELSE 0 END AS analysis_score FROM q1)"""


def ascii_words(text):
    """Runs of plain letters: DuckDB measures edits on bytes, so its check needs ASCII."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def vocabulary_words(s, d, least, cut=words):
    docs = table(s, d, "documents")
    return (docs.select("lang", F.explode(cut(F.col("text"))).alias("word")).groupBy("lang", "word")
            .agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= least))


def _spelling(s, d):
    asked = (table(s, d, "benchmark").select(F.explode(ascii_words(F.col("text"))).alias("word"))
             .select(F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("lang"), "word"))
    return op.correct_spelling(asked, vocabulary_words(s, d, 5, ascii_words))


def _spelling_all(s, d):
    """Whole Unicode words of any frequency, in every language of the texts; no SQL, as DuckDB measures edits on bytes."""
    langs = sorted(r.lang for r in table(s, d, "documents").select("lang").distinct().collect() if r.lang)  # a handful
    asked = table(s, d, "benchmark").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    asked = asked.select(F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"), "word")
    return op.correct_spelling(asked, vocabulary_words(s, d, 1))


def _messages_all(s, d):
    vocab = vocabulary_words(s, d, 1).select(F.col("word").alias("term")).distinct()
    msgs = table(s, d, "conversations").filter("role = 'user'").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return op.correct_messages(msgs, "id", "text", vocab, 0.75, True)


def _messages(s, d):
    vocab = vocabulary_words(s, d, 20).select(F.col("word").alias("term")).distinct()
    msgs = table(s, d, "conversations").filter("role = 'user'").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return op.correct_messages(msgs, "id", "text", vocab, 0.75, True)


def _log(s, d):
    e = table(s, d, "events")
    extra = F.create_map(F.lit("mode"), F.when(F.col("event_id") % 10 < 7, "auto").otherwise("manual"),
                         F.lit("unit"), F.when(F.col("user_id") % 5 < 2, "eur").otherwise("usd"))
    return e.select("event_type", F.map_concat(F.from_json("props", "map<string,string>"), extra).alias("details"))


LOG = """log AS (SELECT event_type AS action, 'k' AS parameter, json_extract_string(props, '$.k') AS value FROM events
  UNION ALL SELECT event_type, 'mode', CASE WHEN event_id % 10 < 7 THEN 'auto' ELSE 'manual' END FROM events
  UNION ALL SELECT event_type, 'unit', CASE WHEN user_id % 5 < 2 THEN 'eur' ELSE 'usd' END FROM events),
 cnt AS (SELECT action, parameter, value, count(*) AS n FROM log GROUP BY ALL),
 top AS (SELECT action, parameter, sum(n) AS total, max(n) AS n, arg_min(value, (-n, value)) AS value FROM cnt GROUP BY ALL),
 freq AS (SELECT event_type AS action, count(*) AS frequency FROM events GROUP BY ALL)"""


def _edges(s, d):
    n, c, o = table(s, d, "nation"), table(s, d, "customer"), table(s, d, "orders")
    tag = lambda t, k: F.concat(F.lit(t + ":"), F.col(k).cast("string"))
    return (n.select(tag("region", "n_regionkey").alias("src"), tag("nation", "n_nationkey").alias("dst"))
            .unionByName(c.select(tag("nation", "c_nationkey").alias("src"), tag("customer", "c_custkey").alias("dst")))
            .unionByName(o.select(tag("customer", "o_custkey").alias("src"), tag("order", "o_orderkey").alias("dst"))))


EDGES = """edges AS (SELECT concat('region:', n_regionkey) AS src, concat('nation:', n_nationkey) AS dst FROM nation
  UNION ALL SELECT concat('nation:', c_nationkey), concat('customer:', c_custkey) FROM customer
  UNION ALL SELECT concat('customer:', o_custkey), concat('order:', o_orderkey) FROM orders),
 down AS (SELECT 'nation:3' AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM down JOIN edges ON src = node WHERE hops < 2),
 up AS (SELECT 'nation:3' AS node, 0 AS hops UNION SELECT src, hops + 1 FROM up JOIN edges ON dst = node WHERE hops < 2),
 reach AS (SELECT 'downstream' AS direction, node, min(hops) AS hops FROM down WHERE hops > 0 GROUP BY node
   UNION ALL SELECT 'upstream', node, min(hops) FROM up WHERE hops > 0 GROUP BY node)"""


def _search(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    corpus = table(s, d, "embeddings").join(docs, "vec_id").select("vec_id", "embedding", "text")
    asked = table(s, d, "benchmark").join(table(s, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select(
        "item_id", "text", F.when(F.col("item_id") % 2 == 0, F.col("embedding")).otherwise(
            F.transform("embedding", lambda x: (-x).cast("float"))).alias("embedding"))
    return ret.search_with_fallback(asked, corpus, "item_id", "vec_id", "embedding", "text", 5, 0.3)


def _names(s, d):
    cols = sorted({c for cs in ALL.values() for c in cs})
    rows = table(s, d, "region").sparkSession.createDataFrame([(c.replace("_", ""),) for c in cols], "name string")
    return op.match_columns(rows, table(s, d, "lineitem"), how="levenshtein")


QUERIES = {
    "fuzzy_match_levenshtein": lambda s, d: rounded(
        op.fuzzy_match(typos(s, d), table(s, d, "part"), "typo", "p_name", 0.8, "levenshtein"), score=6),
    "fuzzy_match_ratio": lambda s, d: op.fuzzy_match(typos(s, d), table(s, d, "part"), "typo", "p_name", 0.8),
    "ngram_match": lambda s, d: rounded(op.ngram_match(typos(s, d), table(s, d, "part"), "typo", "p_name", 0.5), score=6),
    "ngram_match_jaccard": lambda s, d: rounded(op.ngram_match(typos(s, d), table(s, d, "part"), "typo", "p_name", 0.5, "jaccard"), score=6),
    "correct_messages": _messages,
    "build_vocabulary": lambda s, d: op.build_vocabulary(
        vocabulary_words(s, d, 20).select(F.col("word").alias("term")), ["revenue", "returns"],
        [table(s, d, "nation"), table(s, d, "region"), table(s, d, "part").select("p_name", "p_brand")]),
    "correct_spelling": _spelling,
    "correct_spelling_all": _spelling_all,
    "correct_messages_all": _messages_all,
    "build_vocabulary_all": lambda s, d: op.build_vocabulary(
        vocabulary_words(s, d, 1).select(F.col("word").alias("term")), ["revenue", "returns"],
        [table(s, d, "nation"), table(s, d, "region"), table(s, d, "part").select("p_name", "p_brand")]),
    "classify_intent": lambda s, d: rounded(ret.classify_intent(questions(s, d), "question").drop("question"), confidence=6),
    "classify_intent_docs_only": lambda s, d: rounded(
        ret.classify_intent(questions(s, d), "question", has_tables=False).groupBy("intent", "confidence").agg(F.count(F.lit(1)).alias("n")), confidence=6),
    "intent_matches": lambda s, d: ret.intent_matches(questions(s, d), ["conv_id", "turn"], "question"),
    "chunk": lambda s, d: ret.chunk(table(s, d, "documents"), "doc_id", "text").select(
        "doc_id", "chunk_id", F.length("chunk").cast("long").alias("size"), F.md5("chunk").alias("digest")),
    "chunk_by_marks": lambda s, d: ret.chunk_by_marks(table(s, d, "documents"), "doc_id", "text"),
    "term_weights": lambda s, d: ret.term_weights(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 6).alias("top"), F.round(F.sum("weight"), 5).alias("total")),
    "keyword_tags": lambda s, d: rounded(longs(ret.keyword_tags(table(s, d, "documents"), "doc_id", "text"), "position"), weight=6),
    "vector_topk": lambda s, d: rounded(longs(ret.vector_topk(
        table(s, d, "embeddings"), table(s, d, "embeddings"), "vec_id", "vec_id", "embedding", 5, skip_same_id=True), "rank"), score=6),
    "vector_mmr": lambda s, d: ret.vector_mmr(table(s, d, "embeddings"), table(s, d, "embeddings"), "vec_id", "vec_id", "embedding"),
    "search_with_fallback": _search,
    "match_columns": lambda s, d: rounded(longs(_names(s, d), "rank"), score=6),
    "match_tables": lambda s, d: rounded(op.match_tables(
        typos(s, d), table(s, d, "part"), "p_partkey", "p_partkey", "typo", "p_name", 0.85, "levenshtein"), score=6),
    "near_duplicates": lambda s, d: rounded(op.near_duplicates(table(s, d, "documents"), "doc_id", "text", 0.8), score=6),
    "dedupe": lambda s, d: op.dedupe(table(s, d, "documents"), "doc_id", "text", 0.8),
    "action_patterns": lambda s, d: rounded(activity.action_patterns(_log(s, d), "event_type", "details"), confidence=6),
    "lineage": lambda s, d: longs(activity.lineage(_edges(s, d), "nation:3", "both", 2), "hops"),
    "lineage_impact": lambda s, d: activity.lineage_impact(_edges(s, d), "nation:3", "both", 2),
}

LEV = "1.0::double - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b))::double"
PAIRS = f"{TYPOS}, l AS (SELECT DISTINCT typo AS a FROM typos), k AS (SELECT DISTINCT p_name AS b FROM part)"
GRAMS = """list_concat([substr({v}, i, 2) FOR i IN range(1, length({v}))], [substr({v}, i, 3) FOR i IN range(1, length({v}) - 1)])"""

TFIDF = f"""{PAIRS}, n AS (SELECT count(*) + 1.0::double AS n FROM part),
 ct AS (SELECT b, g, count(*) AS tf FROM (SELECT b, unnest({GRAMS.replace('{v}', 'lower(b)')}) AS g FROM k) GROUP BY ALL),
 copies AS (SELECT p_name AS b, count(*) AS c FROM part GROUP BY ALL), df AS (SELECT g, sum(c) AS df FROM ct JOIN copies USING (b) GROUP BY g),
 qt AS (SELECT a, g, count(*) AS tf FROM (SELECT a, unnest({GRAMS.replace('{v}', 'lower(a)')}) AS g FROM l) GROUP BY ALL),
 qw AS (SELECT a, g, tf * (ln((1 + n) / (2 + coalesce(df, 0))) + 1) AS w FROM qt LEFT JOIN df USING (g), n),
 grid AS (SELECT l.a, ct.b, ct.g, ct.tf * (ln((1 + n) / (1 + df + (qw.g IS NOT NULL)::int)) + 1) AS cw, qw.w AS qw
   FROM l CROSS JOIN ct JOIN df USING (g) LEFT JOIN qw ON qw.a = l.a AND qw.g = ct.g, n),
 sc AS (SELECT a, b, sum(cw * qw) / sqrt(sum(cw * cw)) AS part_score FROM grid GROUP BY a, b),
 qn AS (SELECT a, sqrt(sum(w * w)) AS qn FROM qw GROUP BY a)"""

DOC_SETS = f"""sets AS (SELECT min(doc_id) AS id, w FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS w FROM documents) WHERE len(w) > 0 GROUP BY w),
 tok AS (SELECT id, len(w) AS n, unnest(w) AS t FROM sets),
 common AS (SELECT x.id AS left_key, y.id AS right_key, x.n AS nx, y.n AS ny, count(*) AS c FROM tok x JOIN tok y ON x.t = y.t AND x.id < y.id
   WHERE least(x.n, y.n) >= 0.799999 * greatest(x.n, y.n) GROUP BY ALL),
 near AS (SELECT left_key, right_key, c / (nx + ny - c)::double AS score FROM common WHERE c / (nx + ny - c)::double >= 0.8)"""

VOC20 = f"(SELECT w AS term FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM documents) GROUP BY lang, w HAVING count(*) >= 20)"

WEIGHTS = f"""tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents) GROUP BY ALL),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::double / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term),
 tw AS (SELECT doc_id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS weight FROM tc JOIN idf USING (term))"""


def _marked_chunks(size: int, overlap: int) -> str:
    """Pieces of each level with their places, runs of short ones, and a walk from window to window over their ends."""
    blank = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    parts = ["RECURSIVE src0 AS (SELECT doc_id, 0 AS base, text AS body FROM documents WHERE length(text) > 0)"]
    for n, mark in enumerate(("chr(10) || chr(10)", "chr(10)", "' '")):
        parts.append(f"""cut{n} AS (SELECT doc_id, base, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, base, string_split(body, {mark}) AS ps FROM src{n})),
 whole{n} AS (SELECT doc_id, base, i, CASE WHEN i = 1 THEN p ELSE {mark} || p END AS piece FROM cut{n}),
 span{n} AS (SELECT doc_id, base, piece, length(piece) AS n, base + sum(length(piece)) OVER w - length(piece) AS pos, count(*) FILTER (WHERE length(piece) >= {size}) OVER w AS run
   FROM whole{n} WHERE piece <> '' WINDOW w AS (PARTITION BY doc_id, base ORDER BY i)),
 src{n + 1} AS (SELECT doc_id, pos AS base, piece AS body FROM span{n} WHERE n >= {size}),
 runs{n} AS (SELECT doc_id, min(pos)::bigint AS s, list((pos + n)::bigint ORDER BY pos) AS ends FROM span{n} WHERE n < {size} GROUP BY doc_id, base, run)""")
    parts.append(f"""runs AS (SELECT * FROM runs0 UNION ALL SELECT * FROM runs1 UNION ALL SELECT * FROM runs2
   UNION ALL SELECT doc_id, base::bigint, list_transform(range(1, length(body) + 1), lambda x: (base + x)::bigint) FROM src3),
 walk AS (SELECT doc_id, s, list_max(list_filter(ends, lambda x: x <= s + {size})) AS e, ends FROM runs
   UNION ALL SELECT doc_id, t, list_max(list_filter(ends, lambda x: x <= t + {size})), list_filter(ends, lambda x: x > t) FROM (
     SELECT doc_id, ends, list_min(list_filter(ends, lambda x: x >= e - least({overlap}, {size} - (list_min(list_filter(ends, lambda y: y > e)) - e)))) AS t
     FROM walk WHERE e < list_max(ends))),
 trimmed AS (SELECT doc_id, s, trim(substr(text, s::bigint + 1, (e - s)::bigint), '{blank}') AS chunk FROM walk JOIN documents USING (doc_id))""")
    return f"WITH {', '.join(parts)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_id, chunk FROM trimmed WHERE chunk <> ''"


ORACLES = {
    "fuzzy_match_levenshtein": f"WITH {PAIRS} SELECT a AS left_value, b AS right_value, {r(LEV)} AS score FROM l, k WHERE {LEV} >= 0.8",
    "ngram_match": f"WITH {TFIDF} SELECT a AS left_value, b AS right_value, {r('part_score / qn')} AS score FROM sc JOIN qn USING (a) WHERE part_score / qn >= 0.5",
    "ngram_match_jaccard": f"""WITH {PAIRS}, ga AS (SELECT DISTINCT a, unnest({GRAMS.replace('{v}', 'lower(a)')}) AS g FROM l), gb AS (SELECT DISTINCT b, unnest({GRAMS.replace('{v}', 'lower(b)')}) AS g FROM k),
        na AS (SELECT a, count(*) AS n FROM ga GROUP BY a), nb AS (SELECT b, count(*) AS m FROM gb GROUP BY b),
        j AS (SELECT a, b, count(*) AS c FROM ga JOIN gb USING (g) GROUP BY a, b), s AS (SELECT a, b, c / (n + m - c)::double AS score FROM j JOIN na USING (a) JOIN nb USING (b))
        SELECT a AS left_value, b AS right_value, {r('score')} AS score FROM s WHERE score >= 0.5""",
    "build_vocabulary": f"""WITH rows_ AS (SELECT term, 0 AS o FROM {VOC20} UNION ALL SELECT unnest(['revenue', 'returns']), 1
          UNION ALL SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'r_regionkey', 'r_name', 'p_name', 'p_brand']), 2
          UNION ALL SELECT unnest([n_nationkey::varchar, n_name, n_regionkey::varchar]), 3 FROM nation UNION ALL SELECT unnest([r_regionkey::varchar, r_name]), 3 FROM region
          UNION ALL SELECT unnest([p_name, p_brand]), 3 FROM part)
        SELECT term, ['common', 'special', 'column', 'cell'][min(o) + 1] AS origin FROM rows_ GROUP BY term""",
    "correct_spelling": f"""WITH dict AS (SELECT lang, w AS entry, count(*) AS freq FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS w FROM documents) GROUP BY ALL HAVING count(*) >= 5),
        asked AS (SELECT DISTINCT unnest(['en', 'fr']) AS lang, word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS word FROM benchmark)),
        flag AS (SELECT a.lang, a.word, d.entry IS NOT NULL AS is_known FROM asked a LEFT JOIN dict d ON a.lang = d.lang AND a.word = d.entry),
        near AS (SELECT f.lang, word, entry, freq, damerau_levenshtein(word, entry) AS e FROM flag f JOIN dict d ON f.lang = d.lang AND abs(length(word) - length(entry)) <= 2
          WHERE NOT is_known AND damerau_levenshtein(word, entry) <= 2),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY e, freq DESC, entry) AS rn, count(*) OVER (PARTITION BY lang, word, e) AS c FROM near)
        SELECT f.lang, f.word, is_known, coalesce(entry, f.word) AS corrected, coalesce(c, 0)::bigint AS candidates FROM flag f LEFT JOIN best b ON b.lang = f.lang AND b.word = f.word AND rn = 1""",
    "classify_intent": f"""WITH {INTENT}, q3 AS (SELECT conv_id, turn, sql_score, analysis_score, document_score, asks,
          CASE WHEN sql_score > 0 AND sql_score >= analysis_score THEN 1 WHEN analysis_score > 0 THEN 2 WHEN document_score > 0 THEN 3 WHEN asks THEN 4 ELSE 5 END AS c FROM q2)
        SELECT conv_id, turn, sql_score, analysis_score, document_score, ['sql_generation', 'data_analysis', 'document_search', 'data_analysis', 'general_question'][c] AS intent,
          {r("CASE c WHEN 1 THEN least(0.9, 0.6 + sql_score * 0.1) WHEN 2 THEN least(0.9, 0.7 + analysis_score * 0.05) WHEN 3 THEN least(0.9, 0.8 + document_score * 0.05) WHEN 4 THEN 0.6 ELSE 0.5 END::double")} AS confidence FROM q3""",
    "classify_intent_docs_only": f"""WITH {INTENT}, q3 AS (SELECT sql_score, document_score, CASE WHEN sql_score > 0 AND sql_score >= analysis_score THEN 1 WHEN document_score > 0 THEN 3 ELSE 5 END AS c FROM q2),
        q4 AS (SELECT ['sql_generation', 'data_analysis', 'document_search', 'data_analysis', 'general_question'][c] AS intent,
          {r("CASE c WHEN 1 THEN least(0.9, 0.6 + sql_score * 0.1) WHEN 3 THEN least(0.9, 0.8 + document_score * 0.05) ELSE 0.5 END::double")} AS confidence FROM q3)
        SELECT intent, confidence, count(*) AS n FROM q4 GROUP BY ALL""",
    "intent_matches": f"WITH {QUESTIONS} " + union(
        f"SELECT conv_id, turn, '{f}' AS family, {i}::bigint AS pattern FROM questions WHERE regexp_matches(low, '{p}')"
        for f, ps in (("sql", fixed.SQL_PATTERNS), ("analysis", fixed.ANALYSIS_PATTERNS), ("document", fixed.DOCUMENT_PATTERNS)) for i, p in enumerate(ps)),
    "chunk": """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 800)) AS s FROM documents WHERE length(text) > 0),
        p AS (SELECT doc_id, s // 800 AS chunk_id, substr(text, s + 1, 1000) AS t FROM c) SELECT doc_id, chunk_id, length(t) AS size, md5(t) AS digest FROM p""",
    "chunk_by_marks": _marked_chunks(1000, 200),
    "term_weights": f"WITH {WEIGHTS} SELECT doc_id, count(*) AS terms, round(max(weight), 6) AS top, round(sum(weight), 5) AS total FROM tw GROUP BY doc_id",
    "keyword_tags": f"""WITH {WEIGHTS}, k AS (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS position FROM tw)
        SELECT doc_id, position, term, {r('weight')} AS weight FROM k WHERE position <= 5""",
    "vector_topk": f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) SELECT query_id, rank, id, {r('score')} AS score FROM k WHERE rank <= 5""",
    "match_columns": f"""WITH l AS (SELECT unnest([{', '.join(repr(c.replace('_', '')) for c in sorted({c for cs in ALL.values() for c in cs}))}]) AS a), k AS ({each(ALL['lineitem'], "SELECT '{c}' AS b, count({c}) AS filled FROM lineitem")}),
        s AS (SELECT DISTINCT a, b, filled, {LEV} AS score FROM l, k WHERE {LEV} >= 0.8), o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s)
        SELECT a AS name, b AS column_name, {r('score')} AS score, rank, filled FROM o WHERE rank <= 3""",
    "match_tables": f"""WITH {PAIRS}, s AS (SELECT a, b, {LEV} AS score FROM l, k WHERE {LEV} >= 0.85), x AS (SELECT typo AS a, count(*) AS left_rows, min(p_partkey) AS left_key FROM typos GROUP BY typo),
        y AS (SELECT p_name AS b, count(*) AS right_rows, min(p_partkey) AS right_key FROM part GROUP BY p_name)
        SELECT a AS left_value, b AS right_value, {r('score')} AS score, left_rows, left_key, right_rows, right_key FROM s JOIN x USING (a) JOIN y USING (b)""",
    "near_duplicates": f"WITH {DOC_SETS} SELECT left_key, right_key, {r('score')} AS score FROM near",
    "dedupe": f"""WITH RECURSIVE {DOC_SETS}, link AS (SELECT left_key AS u, right_key AS v FROM near UNION SELECT right_key, left_key FROM near),
        walk AS (SELECT u AS node, u AS seen FROM link UNION SELECT node, v FROM walk JOIN link ON seen = u),
        comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
        rows_ AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS w FROM documents)
        SELECT doc_id, CASE WHEN len(rows_.w) = 0 THEN doc_id ELSE coalesce(component, id) END AS cluster FROM rows_ LEFT JOIN sets ON rows_.w = sets.w LEFT JOIN comp ON sets.id = comp.node""",
    "action_patterns": f"""WITH {LOG}, t AS (SELECT *, n / total::double > 0.6 AND frequency >= 3 AS strong, concat(parameter, '=', value) AS pair FROM top JOIN freq USING (action))
        SELECT action, frequency, count(*) AS parameters, count(*) FILTER (WHERE strong) AS patterns, coalesce(string_agg(pair, ',' ORDER BY pair) FILTER (WHERE strong), '') AS common_values,
          coalesce(string_agg(pair, ',' ORDER BY pair) FILTER (WHERE frequency >= 5), '') AS defaults, {r('count(*) FILTER (WHERE strong) / count(*)::double')} AS confidence FROM t GROUP BY action, frequency""",
    "lineage": f"WITH RECURSIVE {EDGES} SELECT direction, node, hops::bigint AS hops FROM reach",
    "lineage_impact": f"""WITH RECURSIVE {EDGES}, c AS (SELECT count(*) FILTER (WHERE direction = 'upstream') AS upstream, count(*) FILTER (WHERE direction = 'downstream') AS downstream FROM reach)
        SELECT *, upstream + downstream AS connected, least(100, 10 * (upstream + downstream))::bigint AS impact_score,
          CASE WHEN upstream + downstream > 5 THEN 'high' WHEN upstream + downstream > 2 THEN 'medium' ELSE 'low' END AS risk FROM c""",
}

#: The same check on words of any frequency.
ORACLES["build_vocabulary_all"] = ORACLES["build_vocabulary"].replace("count(*) >= 20", "count(*) >= 1")
