"""Query variants as Spark makes them, against the plain function."""

import re

from knotwork.operators import retrieve as R

TERMS = {"ada lovelace": ["charles babbage"], "archive": ["national library"], "u.s. army": ["us$ navy\\x"], "new york city": ["boston"], "école": ["lycée"], "ada": ["grace"], "c++": ["rust"]}


def expand_query(question, synonyms, most=5):
    """The question and variants in which a word or phrase gives way to a related name, in plain Python."""
    low, variants = question.lower(), [question]
    for word in low.split():
        variants += [re.sub(rf"\b{re.escape(word)}\b", lambda _, s=s: s, question, flags=re.I) for s in synonyms.get(word, [])]
    for term, related in synonyms.items():
        if term in low:
            variants += [re.sub(re.escape(term), lambda _, s=s: s, question, flags=re.I) for s in related[:2]]
    return list(dict.fromkeys(variants))[:most]


def test_variants_by_names_of_several_words(spark):
    asked = ["Who was Ada Lovelace?", "Where is the archive?", "Did the U.S. Army move to New York City, then?", "Was the ÉCOLE old", "Is c++ hard?", "Nothing here", "?!", ""]
    questions = spark.createDataFrame([(q, q) for q in asked] + [("null", None)], "k string, q string")
    synonyms = spark.createDataFrame([("g", t, r, 0.9) for t, related in TERMS.items() for r in related], "graph_id string, term string, related string, weight double")
    got = {}
    for r in R.expanded(questions, synonyms, "k", "q").collect():
        got.setdefault(r.k, set()).add(r.variant)
    assert got.pop("null") == {None}
    assert got == {q: set(expand_query(q, TERMS)) for q in asked}
    assert sum(len(v) for v in got.values()) == len(asked) + 7


def test_no_synonyms(spark):
    questions = spark.createDataFrame([("a", "Who?")], "k string, q string")
    none = spark.createDataFrame([], "graph_id string, term string, related string, weight double")
    assert [tuple(r) for r in R.expanded(questions, none, "k", "q").collect()] == [("a", "Who?")]
