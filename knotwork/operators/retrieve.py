"""Retrieval: question routing, decomposition, expansion, seeds, traversal and ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import EDGE, dense_cosine, six
from knotwork.operators.spread import among, crowded, join_apart
from knotwork.session import materialise

#: How many seeds and nodes each kind of question gets, and whether its seeds are spread over files and favour summaries. Fixed values.
STRATEGIES = {
    "single-session-user": (24, 20, False, False),
    "single-session-assistant": (24, 20, False, False),
    "single-session-preference": (28, 25, False, False),
    "multi-session": (40, 50, True, True),
    "temporal-reasoning": (32, 40, True, True),
    "knowledge-update": (32, 40, True, True),
}
#: Cues of the kinds of questions, tried in this order. Fixed values.
CUES = [
    ("single-session-assistant", r"(remind me (what|of|about|how)|you (said|mentioned|told me|suggested|recommended|advised|explained|provided|gave me|listed)|your (answer|response|suggestion|recommendation|advice|explanation|list)|what did you (say|tell me|mention|suggest|recommend|list)|(our|the) previous (chat|conversation|discussion)|(earlier|last time) (we|you) (talked|spoke|discussed|mentioned|chatted|said)|in our (previous|earlier|last) (chat|conversation|discussion))"),
    ("multi-session", r"(how many (?!(?:days?|weeks?|months?|years?|hours?) (?:ago|since|between|later|passed|elapsed|have (?:passed|elapsed|been)|has (?:passed|elapsed|been)|it\s+been)\b)|how much (?!(?:longer|more time|time)\b)|average (?:age|score|price|cost|rating|number)\b|in total\b|grand total\b|across (?:all|multiple)\b|combined\b|altogether\b)"),
    ("temporal-reasoning", r"(how long (ago|since)|how many (days?|weeks?|months?|years?|hours?) (ago|passed|elapsed|since|between|have|has)|(days?|weeks?|months?|years?) (ago|passed|elapsed)|passed since|elapsed since|(came|happened) (first|last|before|after)|before or after|which came (first|last)|(which|who|what) .{0,80}\b(first|last|most recent(ly)?)\b(,| or | and )|in (what|the) (order|sequence)|what is the order|chronolog|earliest|latest time|most recently|when did (i|we|you)|what date|on what (day|date)|first time I|last time I|time (between|since|elapsed)|last (monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|weekend)|past (weekend|week|month|year)|valentine'?s day|new year'?s|\b(first|second|third|fourth|fifth|last),\s+(the|and|second|third|fourth|fifth))"),
    ("single-session-preference", r"(favorite|favourite|prefer|preference|usually|typically|habit|routine|tend to|like to|love to|hate|enjoy|(my|I) (preferred|usual|typical)|can you (recommend|suggest)|could you (recommend|suggest)|any (tips|advice|suggestions|ideas|recommendations|thoughts)|what should I (serve|wear|watch|eat|read|try|do|cook|make|buy|get|order|play|listen)|do you have any (ideas|suggestions|recommendations|tips)|i('ve| have) been (struggling|thinking|feeling|wanting) .*(any|tips|advice|ideas|suggest)|looking for (some|any) (ideas|recommendations|suggestions|tips)|should I\b|what do you think|would you (recommend|suggest)|what would you (recommend|suggest|advise))"),
    ("knowledge-update", r"(currently|these days|most recent\b|latest|still (have|work|live|own|use|play|attend|go|take|run|write)|no longer|any\s*more|updated|recently (moved|changed|started|switched|bought|got)|recent (move|relocation|change|update|switch|job|role|position|trip|visit)|new (job|address|home|apartment|name|role|car|gym|workplace|hobby)|moved to|switched to|used to (be|have|live|work|go|own|attend)|since I (started|began|moved|switched|changed|got|joined)|(my|our) (current|latest|new|newest) |personal best|now (have|own|use|play|work|live|run)|after (his|her|their|my) (recent|relocation|move|change)|how long have I\b|how often do I\b|how often does\b|\bso far\b|before I (purchased|bought|got|started|switched|moved|changed)|before getting\b|more frequently than|(previous|current) (status|version|role|job|gym|address|tutor|coach|doctor|therapist))"),
    ("multi-session", r"(total|how many|how much|number of|count of|sum of|all of the|every time|each time|across (all|multiple)|combined|altogether|in total)"),
]
#: Concepts that question patterns ask for, tried in this order. Fixed values.
CONCEPTS = [
    (r"how\s+did\s+(.+?)\s+(?:influence|affect|impact|change|shape)", "influence impact effect"),
    (r"what\s+is\s+the\s+relationship\s+between", "relationship connection link"),
    (r"(?:compare|difference|similar)", "comparison difference similarity"),
    (r"(?:cause|reason|why)", "cause reason explanation"),
    (r"(?:timeline|history|evolution|develop)", "history development timeline evolution"),
    (r"(?:invented|created|designed|built)", "invention creation design"),
]
#: Cues of questions for sums and for tastes. Fixed values.
SUMS = "(total|how many|how much|number of|count of|sum of|all of the|every time)"
TASTES = "(favorite|favourite|prefer|preference|usually|typically|habit|routine|tend to|like to|love to|hate|enjoy|style|personal)"
#: Words at which a question falls into clauses, and the forms of named things and quotes in it. Fixed values.
JOINTS = r"(?:and|or|but|how|why|when|where|what|which|between|from|with)"
PHRASE, QUOTE, ACRONYM = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", "\"([^\"]+)\"|'([^']+)'", r"([A-Z]{2,}(?:\s+[A-Z]{2,})*)"


@dataclass(frozen=True)
class Traversal:
    """How far and how strongly scores spread."""

    hops: int = 3
    decay: float = 0.6
    backward: float = 0.5
    nodes: int = 20
    blocked: tuple[str, ...] = ()


def question_type(question: Column) -> Column:
    """The kind of a question by the first cue that it holds."""
    kind = None
    for name, cue in CUES:
        holds = question.rlike(f"(?i){EDGE}{cue}{EDGE}".replace(r"\b", EDGE))
        kind = F.when(holds, name) if kind is None else kind.when(holds, name)
    return F.when(question.isNotNull(), kind.otherwise("single-session-user"))


def asks_for_sum(question: Column) -> Column:
    """Whether a question asks for a count or a sum."""
    return question.rlike(f"(?i){EDGE}{SUMS}{EDGE}")


def asks_for_taste(question: Column) -> Column:
    """Whether a question asks for what somebody likes or usually does."""
    return question.rlike(f"(?i){EDGE}{TASTES}{EDGE}")


def strategy_of(kind: Column) -> Column:
    """(max_seeds, max_nodes, spread, summaries) for a kind of question."""
    parts = F.create_map(*[x for k, v in STRATEGIES.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for y, n in zip(v, ("max_seeds", "max_nodes", "spread", "summaries"))]))])
    return parts[kind]


def sub_queries(question: Column, most: int = 6, least_chars: int = 10) -> Column:
    """The question and its parts: capitalised phrases, quotes, acronyms, the asked concept and its clauses, each once."""
    phrases = F.regexp_extract_all(question, F.lit(f"{EDGE}{PHRASE}{EDGE}"), F.lit(1))
    quotes = F.regexp_extract_all(question, F.lit(QUOTE), F.lit(0))
    acronyms = F.regexp_extract_all(question, F.lit(f"{EDGE}{ACRONYM}{EDGE}"), F.lit(1))
    named = F.concat(phrases, F.transform(quotes, lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), acronyms)
    named = F.filter(named, lambda p: F.lower(p) != F.lower(question))
    concept = None
    for cue, words in CONCEPTS:
        concept = F.when(question.rlike(f"(?i){cue}"), words) if concept is None else concept.when(question.rlike(f"(?i){cue}"), words)
    clauses = F.filter(F.transform(F.split(question, f"(?i){EDGE}{JOINTS}{EDGE}"), lambda c: F.trim(c)), lambda c: F.length(c) > least_chars)
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(question), named, F.array(concept), clauses))), 1, most)


def synonym_map(nodes: DataFrame, undirected: DataFrame, least: float = 0.4, top: int = 5, kept: float = 0.5) -> DataFrame:
    """(graph_id, term, related, weight, place): names that strong edges bring together, the `top` of each by weight.

    Weights add up from an edge's first end to its second, as stored; names are
    compared in lower case; ties go by name.
    """
    strong = undirected.where(F.col("edge_type").isin("similar-to", "shares-entity") & (F.col("weight") >= least)).select("graph_id", "node_a", "node_b", "weight")
    names = nodes.select("graph_id", "node_id", F.explode("entities").alias("e")).select("graph_id", "node_id", F.lower("e").alias("e"))
    x = strong.join(names.select("graph_id", F.col("node_id").alias("node_a"), F.col("e").alias("term")), ["graph_id", "node_a"])
    both = x.join(names.select("graph_id", F.col("node_id").alias("node_b"), F.col("e").alias("related")), ["graph_id", "node_b"]).where("term <> related")
    sums = both.groupBy("graph_id", "term", "related").agg(F.round(F.sum("weight"), 6).alias("weight"))
    order = Window.partitionBy("graph_id", "term").orderBy(F.desc("weight"), "related")
    return sums.withColumn("place", F.row_number().over(order)).where((F.col("place") <= top) & (F.col("weight") > kept))


def bare_words(text: Column) -> Column:
    """The words of a text in lower case, in order, without punctuation."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def expanded(questions: DataFrame, synonyms: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """(key, variant): every question with the variants that related names give it.

    Questions and names meet in an equi-join on runs of words without
    punctuation, as long as the names are, by hash; the name itself is then looked
    for in the question, as whole words. Names without a letter or digit match nothing.
    """
    best = synonyms.groupBy("term", "related").agg(F.max("weight").alias("weight"))
    best = materialise(best.withColumn("parts", bare_words(F.col("term"))).where(F.size("parts") > 0), "synonyms")
    lengths = F.array(*[F.lit(r[0]) for r in best.select(F.size("parts")).distinct().collect()]).cast("array<int>")
    words = F.col("words")
    fit = lambda i: F.filter(lengths, lambda n: i + n <= F.size(words) + 1)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(fit(i), lambda n: F.array_join(F.slice(words, i, n), " "))))
    asked = questions.select(key, bare_words(F.col(text)).alias("words")).where(F.size("words") > 0).select(key, F.explode(F.array_distinct(runs)).alias("run"))
    asked = asked.select(key, F.xxhash64("run").alias("run"))
    met = asked.join(best.select(F.xxhash64(F.array_join("parts", " ")).alias("run"), "term", "related", "weight"), "run").drop("run")
    swapped = met.join(questions.select(key, text), key)
    whole = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    swapped = swapped.withColumn("variant", F.regexp_replace(F.col(text), whole, F.regexp_replace("related", r"([\\$])", r"\\$1"))).where(F.col("variant") != F.col(text))
    place = Window.partitionBy(key).orderBy(F.desc("weight"), "variant")
    more = swapped.groupBy(key, "variant").agg(F.max("weight").alias("weight")).withColumn("n", F.row_number().over(place)).where(F.col("n") < most)
    return questions.select(key, F.col(text).alias("variant")).unionByName(more.select(key, "variant"))


def merged_seeds(*pools: DataFrame, key: str, node: str | list[str]) -> DataFrame:
    """(key, node, score): the best score of every node over all pools; node is one column or several."""
    keys = [key, *([node] if isinstance(node, str) else node)]
    rows = None
    for pool in pools:
        part = pool.select(*keys, "score")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*keys).agg(F.max("score").alias("score"))


def summary_policy(seeds: DataFrame, kind: str = "node_type", prefer: str = "summaries", boost: float = 1.3) -> DataFrame:
    """seeds with session summaries raised by `boost` where the question's strategy prefers them, and left out where it does not.

    kind is the node's type, prefer the strategy's flag; where the flag is null nothing changes.
    """
    is_summary = F.coalesce(F.col(kind) == "session-summary", F.lit(False))
    kept = seeds.where(~is_summary | F.coalesce(F.col(prefer), F.lit(True)))
    return kept.withColumn("score", F.when(is_summary & F.coalesce(F.col(prefer), F.lit(False)), six(F.col("score") * boost)).otherwise(F.col("score")))


def diversified(seeds: DataFrame, key: str, node: str, source: str, cap: int | str) -> DataFrame:
    """seeds dealt round by round: the best of every source, then the second best, up to cap; sources in the order of their best seed.

    cap is a number or a column. If there are no more than cap seeds all are kept and the order does not matter.
    """
    ranked = seeds.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), node)))
    turns = ranked.withColumn("_turn", F.row_number().over(Window.partitionBy(key, source).orderBy("_n")))
    turns = turns.withColumn("_first", F.min("_n").over(Window.partitionBy(key, source)))
    dealt = turns.withColumn("pick_no", F.row_number().over(Window.partitionBy(key).orderBy("_turn", "_first")))
    return dealt.where(F.col("pick_no") <= (F.col(cap) if isinstance(cap, str) else cap)).drop("_n", "_turn", "_first")


def neighbours(directed: DataFrame, undirected: DataFrame, nodes: DataFrame, backward: float = 0.5, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(graph_id, node_id, other, weight): every way of a graph from a node to the next that it holds, forward, back at part of the weight, and undirected."""
    directed = directed.where(F.col("weight").isNotNull() & ~F.col("edge_type").isin(*blocked)) if blocked else directed.where("weight is not null")
    undirected = undirected.where(F.col("weight").isNotNull() & ~F.col("edge_type").isin(*blocked)) if blocked else undirected.where("weight is not null")
    way = lambda x, y, w: F.struct(F.col(x).alias("node_id"), F.col(y).alias("other"), w.alias("weight"))
    one = directed.select("graph_id", F.explode(F.array(way("from_node", "to_node", F.col("weight")), way("to_node", "from_node", F.col("weight") * backward))).alias("w"))
    two = undirected.select("graph_id", F.explode(F.array(way("node_a", "node_b", F.col("weight")), way("node_b", "node_a", F.col("weight")))).alias("w"))
    ways = one.unionAll(two).select("graph_id", "w.*").where("node_id is not null and other is not null")
    best = ways.groupBy("graph_id", "node_id", "other").agg(F.max("weight").alias("weight"))
    return best.join(nodes.select("graph_id", F.col("node_id").alias("other")), ["graph_id", "other"], "left_semi").select("graph_id", "node_id", "other", "weight")


def traverse(seeds: DataFrame, ways: DataFrame, key: str, options: Traversal = Traversal()) -> DataFrame:
    """(key, graph_id, node_id, score): scores that spread from seeds (key, graph_id, node_id, score) over a few hops within their graph.

    All nodes that a hop improved pass on their score times decay times the
    weight of the way; a node keeps its best score. The number of hops is small
    and fixed, so the plan is unrolled. Null ends were left out with the ways;
    the ways of a node with very many of them are followed in several tasks.
    """
    node = ["graph_id", "node_id"]
    scores = materialise(seeds.groupBy(key, *node).agg(F.max("score").alias("score")), "seeds")
    frontier, ways = scores, materialise(ways, "ways")
    hot = crowded(ways, node)
    for _ in range(options.hops):
        step = join_apart(frontier, ways, node, hot).select(key, "graph_id", F.col("other").alias("node_id"), (F.col("score") * options.decay * F.col("weight")).alias("new"))
        step = step.groupBy(key, *node).agg(F.max("new").alias("new"))
        both = materialise(scores.join(step, [key, *node], "full"), "hop")
        better = F.col("new") > F.coalesce("score", F.lit(0.0))
        frontier = both.where(better).select(key, *node, F.col("new").alias("score"))
        scores = both.select(key, *node, F.when(better, F.col("new")).otherwise(F.col("score")).alias("score"))
    return scores.where("score is not null")


def traverse_edges(seeds: DataFrame, directed: DataFrame, undirected: DataFrame, nodes: DataFrame, kinds: DataFrame, key: str, options: Traversal, blocked: dict[str, tuple[str, ...]]) -> DataFrame:
    """traverse() over the edges themselves: (key, graph_id, node_id, score), where a key's kind (key, kind) does not follow the edge types that blocked has for it.

    Every hop reads the edges again and takes only those that may start at a
    node of its frontier, so that the ways of nodes that no seed reaches are
    never shuffled. Of several ways between two nodes the best one counts.
    """
    node = ["graph_id", "node_id"]
    way = lambda x, y, w: F.struct(F.col(x).alias("node_id"), F.col(y).alias("other"), w.alias("weight"))
    one = directed.select("graph_id", "edge_type", F.explode(F.array(way("from_node", "to_node", F.col("weight")), way("to_node", "from_node", F.col("weight") * options.backward))).alias("w"))
    two = undirected.select("graph_id", "edge_type", F.explode(F.array(way("node_a", "node_b", F.col("weight")), way("node_b", "node_a", F.col("weight")))).alias("w"))
    ways = one.unionAll(two).select("graph_id", "edge_type", "w.*").where("node_id is not null and other is not null and weight is not null")
    ways = ways.where(~F.col("edge_type").isin(*options.blocked)) if options.blocked else ways
    stops = F.lit(False)
    for kind, types in blocked.items():
        stops = stops | ((F.col("kind") == kind) & F.col("edge_type").isin(*types))
    scores = materialise(seeds.groupBy(key, *node).agg(F.max("score").alias("score")), "seeds")
    frontier = scores
    for _ in range(options.hops):
        found = materialise(among(ways, frontier, node, 22), "ways")
        ends = found.select("graph_id", F.col("other").alias("node_id"))
        known = among(nodes.select(*node), ends, node, 22).select("graph_id", F.col("node_id").alias("other"))
        held = found.join(known, ["graph_id", "other"], "left_semi")
        step = join_apart(frontier.join(kinds, key), held, node, crowded(found, node)).where(~stops)
        step = step.select(key, "graph_id", F.col("other").alias("node_id"), (F.col("score") * options.decay * F.col("weight")).alias("new")).groupBy(key, *node).agg(F.max("new").alias("new"))
        both = materialise(scores.join(step, [key, *node], "full"), "hop")
        better = F.col("new") > F.coalesce("score", F.lit(0.0))
        frontier = both.where(better).select(key, *node, F.col("new").alias("score"))
        scores = both.select(key, *node, F.when(better, F.col("new")).otherwise(F.col("score")).alias("score"))
    return scores.where("score is not null")


def temporal_factor(last_access: Column, accesses: Column, confidence: Column, valid_until: Column, as_of: Column) -> Column:
    """What recent and frequent use, confidence and expiry make of a score."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_access.cast("timestamp"))) / 86_400_000_000
    recent = F.when(days < 1, 1.3).when(days < 7, 1.1).otherwise(1.0)
    often = F.when(accesses > 10, 1.2).when(accesses > 3, 1.1).otherwise(1.0)
    return recent * often * F.coalesce(confidence, F.lit(1.0)) * F.when(as_of > valid_until, 0.3).otherwise(1.0)


def top_nodes(scores: DataFrame, nodes: DataFrame, key: str, as_of: str, most: int | str) -> DataFrame:
    """(key, graph_id, node_id, score, place): the best nodes after temporal re-scoring; ids without a node leave first.

    most is a number or a column of scores.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    factor = temporal_factor(F.col("last_accessed_at"), F.col("access_count"), F.col("confidence"), F.col("valid_until"), now)
    kept = [key, "graph_id", "node_id", *([most] if isinstance(most, str) else [])]
    held = scores.join(nodes.select("graph_id", "node_id", factor.alias("f")), ["graph_id", "node_id"]).select(*kept, six(F.col("score") * F.col("f")).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "node_id", "graph_id")
    placed = held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= (F.col(most) if isinstance(most, str) else most))
    return placed.select(key, "graph_id", "node_id", "score", "place")


def edges_between(chosen: DataFrame, edges: DataFrame, key: str, ends: tuple[str, str]) -> DataFrame:
    """The edges of which both ends were chosen for a key in the edge's graph."""
    one = chosen.select(key, "graph_id", F.col("node_id").alias(ends[0]))
    two = chosen.select(key, "graph_id", F.col("node_id").alias(ends[1]))
    return edges.join(one, ["graph_id", ends[0]]).join(two, [key, "graph_id", ends[1]])


def likeness(vectors: DataFrame, embedding: str, queries: DataFrame, block: int = 1000) -> DataFrame:
    """Every row of vectors with every query of a stated set (q, query): q, the row's other columns and cosine.

    The queries are sent to the rows in blocks of about `block`, one scan for
    each, so that what is broadcast stays bounded.
    """
    n_blocks = -(-queries.count() // block) or 1
    out = None
    for b in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).agg(F.collect_list(F.struct("q", "query")).alias("asked"))
        each = vectors.join(F.broadcast(part), F.lit(True)).withColumn("a", F.explode("asked"))
        each = each.select("a.q", *[c for c in vectors.columns if c != embedding], dense_cosine(F.col(embedding), F.col("a.query")).alias("cosine"))
        out = each if out is None else out.unionByName(each)
    return out


def reranked(scores: DataFrame, likeness: DataFrame, key: str, node: str | list[str]) -> DataFrame:
    """(key, node, score): half the score over its key's best, half the cosine; nodes without a vector keep the former whole."""
    node = [node] if isinstance(node, str) else node
    best = F.max("score").over(Window.partitionBy(key))
    both = scores.join(likeness, [key, *node], "left").withColumn("part", F.col("score") / best)
    blended = F.when(F.col("cosine").isNull(), F.col("part")).otherwise(0.5 * F.col("part") + 0.5 * F.greatest(F.col("cosine"), F.lit(0.0)))
    return both.select(key, *node, six(blended).alias("score"))


def sibling_turns(chosen: DataFrame, nodes: DataFrame, key: str, factor: float = 0.9) -> DataFrame:
    """chosen (key, graph_id, node_id, score) with the user's turn of every chosen assistant turn of one file, at part of its score, if it is not there."""
    node = ["graph_id", "node_id"]
    part = lambda who: F.col("section").rlike(rf"(?i)^{who} \(turn [0-9]+\)$")
    turns = nodes.select(*node, F.col("source.file").alias("file"), F.col("source.section").alias("section"), F.regexp_extract("source.section", r"([0-9]+)\)$", 1).alias("turn"))
    answers = chosen.join(turns.where(part("assistant")), node).select(key, "graph_id", "file", "turn", "score")
    asked = answers.join(turns.where(part("user")), ["graph_id", "file", "turn"]).groupBy(key, *node).agg(six(F.max("score") * factor).alias("score"))
    return chosen.select(key, *node, "score").unionByName(asked.join(chosen.select(key, *node), [key, *node], "left_anti"))


def weakened_by_summary(chosen: DataFrame, nodes: DataFrame, directed: DataFrame, key: str, factor: float = 0.5) -> DataFrame:
    """chosen with the score halved of nodes that a chosen summary of their graph sums up."""
    summaries = chosen.join(nodes.where("node_type = 'session-summary'").select("graph_id", "node_id"), ["graph_id", "node_id"]).select(key, "graph_id", F.col("node_id").alias("from_node"))
    children = directed.where("edge_type = 'summarizes'").join(summaries, ["graph_id", "from_node"]).select(key, "graph_id", F.col("to_node").alias("node_id"), F.lit(True).alias("under")).distinct()
    return chosen.join(children, [key, "graph_id", "node_id"], "left").withColumn("score", F.when(F.col("under"), F.col("score") * factor).otherwise(F.col("score"))).drop("under")
