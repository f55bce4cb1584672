"""Queries on all of their input, beside the narrower ones that SQL checks."""

from collections import Counter

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TEXTS = {"de": ["über das Wasser über Brücke", "das grüne Wasser"], "en": ["the water over the bridge", "green water"],
         "fr": ["une élève école", "école verte"], "es": ["mañana agua", "agua verde"]}
ASKED = ["übr wassr brüke élève", "ecole watr manana verde"]


def edits(a, b):
    """Edits with swaps of neighbours, by the full table."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_spelling_takes_whole_words_of_all_languages(spark, tmp_path):
    docs = [(text, lang) for lang, texts in TEXTS.items() for text in texts]
    spark.createDataFrame(docs, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in ASKED], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.lang, r.word): r for r in entry.queries()["correct_spelling_all"](spark, str(tmp_path)).collect()}
    assert set(got) == {(lang, w) for lang in TEXTS for t in ASKED for w in t.split()}
    for (lang, word), r in got.items():
        freq = Counter(w for text in TEXTS[lang] for w in text.lower().split())
        near = {e: edits(word, e) for e in freq}
        best = min(near.values())
        tier = [e for e in freq if near[e] == best] if 0 < best <= 2 else []
        assert (r.is_known, r.candidates) == (word in freq, len(tier)), (lang, word)
        assert r.corrected == (min(tier, key=lambda e: (-freq[e], e)) if tier else word), (lang, word)


def test_lone_points_are_clustered(spark):
    every = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert entry.queries()["kmeans_all"](spark, SF).count() == every > entry.queries()["kmeans"](spark, SF).count()
    assert entry.queries()["silhouette_exact_all"](spark, SF).first()["rows"] == every
