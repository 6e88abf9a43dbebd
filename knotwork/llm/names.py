"""Linking the spellings of one person or organisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.spread import met_in_blocks
from knotwork.session import materialise, ship

#: English given names with their short forms. Fixed values.
GIVEN = {
    "abigail": "abby abbie gail", "adam": "", "albert": "al bert bertie", "alexander": "alex sandy xander al alec", "alice": "", "amanda": "mandy",
    "andrew": "andy drew", "anna": "annie", "anthony": "tony", "arthur": "art", "barbara": "barb babs", "benjamin": "ben benny benji",
    "brian": "", "caroline": "carrie", "catherine": "cathy kate kit cat", "charles": "charlie chuck chas", "charlotte": "lottie charlie",
    "christina": "tina chrissie chris", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby",
    "dennis": "denny", "diana": "di", "donald": "don donnie", "dorothy": "dot dottie dolly dora", "edmund": "ed ned", "edward": "ed eddie ned ted teddy",
    "eleanor": "ellie nell nellie nora ella", "elizabeth": "liz beth betsy betty eliza lizzie libby bess", "emily": "em", "emma": "em", "eric": "",
    "evelyn": "eve", "florence": "flo flossie", "frances": "fran frankie fanny francie", "francis": "frank", "frank": "frankie", "franklin": "frank",
    "frederick": "fred freddie freddy rick", "gabriel": "gabe", "george": "georgie", "gerald": "gerry jerry", "gregory": "greg gregg", "hannah": "",
    "harold": "harry hal", "harriet": "hattie harrie", "helen": "nell nellie", "helga": "", "henry": "harry hank hal", "ingrid": "inga", "irene": "",
    "isaac": "ike", "isabella": "bella izzy isa belle", "jacob": "jake", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "janet": "jan",
    "jason": "", "jennifer": "jen jenny", "jeremy": "jerry", "jessica": "jess jessie", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey jo",
    "joshua": "josh", "judith": "judy", "julia": "julie", "katherine": "kate kathy kit katie kay kitty", "kenneth": "ken kenny", "laura": "", "lawrence": "larry laurie lars",
    "leonard": "len lenny leo", "leopold": "leo poldi", "louis": "lou", "louise": "lou", "lucy": "", "margaret": "maggie meg peggy marge greta daisy",
    "maria": "", "martha": "marty", "martin": "marty", "mary": "molly polly", "matthew": "matt", "michael": "mike mick mickey", "nancy": "",
    "nathaniel": "nat nate nathan", "nicholas": "nick nicky", "oliver": "ollie", "olivia": "liv livvy ollie", "oscar": "ossie", "pamela": "pam", "patricia": "pat patty trish tricia",
    "patrick": "pat paddy", "paul": "", "peter": "pete", "philip": "phil", "quentin": "quinn", "rachel": "", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich richie ricky",
    "robert": "rob bob bobby robbie bert", "roger": "", "ronald": "ron ronnie", "rosemary": "rose rosie", "ruth": "", "samantha": "sam", "samuel": "sam sammy", "sandra": "sandy",
    "sarah": "sally", "simon": "", "sophia": "sophie", "stephanie": "steph stevie", "stephen": "steve", "susan": "sue susie suzy", "theodore": "ted theo teddy",
    "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "ursula": "ursa ursie", "victor": "vic", "victoria": "vicky tori vicki", "vincent": "vince vinny vin",
    "virginia": "ginny", "walter": "walt wally", "william": "will bill billy willie liam", "yvonne": "vonnie evie", "zachary": "zach zack zak",
}
#: Legal forms with their abbreviations. Fixed values.
LEGAL = {
    "agency": "agcy", "association": "assoc assn ass", "center": "ctr cent", "centre": "", "college": "coll", "commission": "comm", "company": "", "corporation": "corp", "council": "counc",
    "department": "dept dep", "foundation": "found fdn fnd", "group": "grp", "institute": "inst", "laboratory": "lab labs", "ministry": "min", "museum": "mus",
    "observatory": "obs obsv", "society": "soc", "trust": "", "university": "univ uni",
}
#: Company forms with their abbreviations, at the end of a name. Fixed values.
COMPANY = {
    "limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co", "llc": "l.l.c", "llp": "l.l.p", "plc": "p.l.c", "gmbh": "g.m.b.h", "ag": "a.g", "kg": "k.g", "sa": "s.a",
    "sas": "s.a.s", "sarl": "s.a.r.l", "srl": "s.r.l", "spa": "s.p.a", "nv": "n.v", "bv": "b.v", "oy": "oyj", "ab": "a.b", "as": "a.s", "aps": "", "kk": "k.k", "pty": "proprietary", "ev": "e.v",
}
#: Titles before a name, and words between the parts of a name. Fixed values.
TITLES = {"mr", "ms", "mrs", "miss", "dr", "prof", "professor", "sir"}
FILLERS = {"the", "of", "for", "and", "&"}
#: Of the hashes of words without a letter. Fixed values.
PRIME, BASE = (1 << 61) - 1, 1_000_003

SHORT: dict[str, list[str]] = {}
for full, shorts in GIVEN.items():
    for word in shorts.split():
        SHORT.setdefault(word, []).append(full)
LEGAL_OF = {word: full for full, shorts in LEGAL.items() for word in [full, *shorts.split()]}

COMPANY_OF = {word: full for full, shorts in COMPANY.items() for word in [full, *shorts.split()]}


def spoken(word: str) -> bool:
    """Whether a word may hold a slip: it has five letters or more, and no digit or back quote."""
    return len(word) >= 5 and not re.search(r"\d|`", word)


def deletions(word: str) -> set[str]:
    """The word, and if it may hold a slip, also without any one of its letters."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if spoken(word) else set())


def deletion_codes(word: str) -> list[int]:
    """deletions() as hashes, in time in proportion to the length of the word."""
    at = [0]
    for c in word:
        at.append((at[-1] * BASE + ord(c)) % PRIME)
    if not spoken(word):
        return at[-1:]
    codes, power = at[-1:], 1
    for i in range(len(word) - 1, -1, -1):
        # the letters before i move up by one place
        codes.append((at[-1] - at[i + 1] * power + at[i] * power) % PRIME)
        power = power * BASE % PRIME
    return codes


def slip_codes(kind: str, words: list[str], ordered: bool = False) -> list[int]:
    """Hashes of the words, and of them with one letter of one of them left out, in time in proportion to their length; equal for any order of the words unless ordered."""
    from xxhash import xxh3_64_intdigest

    each = [[xxh3_64_intdigest(f"{i if ordered else ''} {c}") for c in deletion_codes(w)] for i, w in enumerate(words)]
    whole = sum(codes[0] for codes in each)
    return [xxh3_64_intdigest(f"{kind} {(whole - codes[0] + c) % (1 << 64)}") for codes in each for c in codes]


NEAR_GIVEN: dict[str, set[str]] = {}
NEAR_LEGAL: dict[str, set[str]] = {}
for words, near in ((GIVEN, NEAR_GIVEN), (LEGAL, NEAR_LEGAL)):
    for full in words:
        for form in deletions(full):
            near.setdefault(form, set()).add(full)


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by one letter more, less or other, or by two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def meant(word: str, table: dict[str, str], near: dict[str, set[str]]) -> list[str]:
    """The words of the table that a word may mean if it has at most one slip."""
    if word in table or len(word) < 4:
        return [word] if word in table else []
    return sorted({full for form in deletions(word) for full in near.get(form, ()) if one_edit(word, full)})


def plain(name: str) -> str:
    """Lower case without accents, with single blanks."""
    folded = unicodedata.normalize("NFKD", name)
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).lower().split())


def organisation(text: str) -> dict | None:
    """Reads a name that holds a legal form: its key, the rewritings that others may use for it, or what it may stand for."""
    parts = [w for w in re.split(r"[\s,]+", text) if w and w.rstrip(".") not in FILLERS]
    if not 2 <= len(parts) <= 5:
        return None
    legal = next((w for w in parts if w.rstrip(".") in LEGAL_OF), None) or next((w for w in parts if len(meant(w, LEGAL, NEAR_LEGAL)) == 1), None)
    if legal is None:
        return None
    rest = sorted(w for w in parts if w is not legal)
    if not rest:
        return None
    form = LEGAL_OF.get(legal.rstrip(".")) or meant(legal, LEGAL, NEAR_LEGAL)[0]
    if len(rest) == 1:
        kind = "w" if form in COMPANY and legal is parts[-1] else "o"  # as company() has it
        return {"key": f"{kind} {rest[0]} {form}", "exact": [f"s {rest[0]} {form}"], "near": [f"s {d} {form}" for d in deletions(rest[0])], "full": False}
    cut = [w for w in rest if w.endswith(".") and len(w) >= 4]
    if len(cut) == 1 and len(rest) == 2:
        other = next(w for w in rest if w is not cut[0])
        return {
            "key": f"o {other} {cut[0]} {form}", "exact": [f"c {other} {cut[0]} {form}"], "near": [f"c {d} {cut[0]} {form}" for d in deletions(other)], "full": False,
        }
    key = f"o {' '.join(rest)} {form}"
    if len(rest) != 2:
        return {"key": key, "exact": [], "near": [], "full": True, "slips": []}
    exact, near, slips = [], [], []
    for x, y in (rest, rest[::-1]):
        slips += [f"t {' '.join(sorted([d, y]))} {form}" for d in deletions(x)]
        ends = [f"s {{}} {form}", f"a {{}} {y[0]}{form[0]}", *(f"c {{}} {y[:n]}. {form}" for n in range(3, min(7, len(y))))]
        exact += [e.format(x) for e in ends]
        near += [e.format(d) for e in ends for d in deletions(x)]
    return {"key": key, "exact": exact, "near": near, "full": True, "slips": slips}


def company(text: str) -> dict | None:
    """Reads a name that ends in the form of a company: as organisation(). The form may be written in several ways, the words before it are kept in order."""
    words = [w for w in re.split(r"[\s,]+", text) if w and w.rstrip(".") not in FILLERS]
    form = COMPANY_OF.get(words[-1].rstrip(".")) if len(words) >= 2 else None
    if form is None:
        return None
    rest = [w.rstrip(".") for w in words[:-1]]
    return {"key": " ".join(["w", *rest, form]), "exact": [], "near": [], "full": True, "slips": slip_codes(f"b {form}", rest, ordered=True), "open": True}


def anyone(text: str) -> dict:
    """Reads any other name, of which nothing is known: as organisation().

    Its key is its words in alphabetical order, without titles, fillers and
    initials in the middle; others may write the first word of two as an initial.
    """
    head, comma, tail = text.partition(",")
    words = [w for w in re.split(r"[\s,]+", f"{tail} {head}" if comma else text) if w and w.rstrip(".") not in TITLES | FILLERS]
    words = [w for i, w in enumerate(words) if not (0 < i < len(words) - 1 and len(w.rstrip(".")) == 1 and w[0].isalpha())]
    words = [w.rstrip(".") if len(w) > 3 else w for w in words] or text.split()
    exact, near = [], []
    if len(words) == 2 and min(map(len, words)) >= 2 and not re.search(r"\d|`", text):
        exact = [f"i {words[0][0]} {words[1]}"]
        near = [f"i {words[0][0]} {d}" for d in deletions(words[1])]
    return {"key": " ".join(["w", *sorted(words)]), "exact": exact, "near": near, "full": True, "slips": slip_codes("v", words), "open": True}


def acronym(text: str) -> dict | None:
    """Reads a name of which only the first word is written out: as organisation(); if it stands for none, it is a company or a name like any other."""
    m = re.fullmatch(r"(?:the )?(\w{4,}) ([a-z]{2,3})\.?", text)
    if m is None:
        return None
    key = [m[1], COMPANY_OF[m[2]]] if m[2] in COMPANY_OF else sorted([m[1], m[2]])
    return {"key": " ".join(["w", *key]), "exact": [f"a {m[1]} {m[2]}"], "near": [f"a {d} {m[2]}" for d in deletions(m[1])], "full": False}


def person(text: str) -> dict | None:
    """Reads the name of a person: as organisation()."""
    head, comma, tail = text.partition(",")
    words = [w for w in (f"{tail} {head}" if comma else text).split() if w.rstrip(".") not in TITLES]
    if len(words) == 3:  # a middle initial
        words = [w for i, w in enumerate(words) if not (i == 1 and re.fullmatch(r"[a-z]\.?", w))]
    if len(words) != 2:
        return None
    words[1] = words[1].rstrip(".") if len(words[1]) > 3 else words[1]
    for first, last in (words,) if comma else (words, words[::-1]):
        if len(last.rstrip(".")) < 3:
            continue
        bare = first.rstrip(".")
        if len(bare) == 1:
            return {"key": f"p {bare}. {last}", "exact": [f"i {bare} {last}"], "near": [f"i {bare} {d}" for d in deletions(last)], "full": False}
        stands = [g for g in GIVEN if g.startswith(bare) and g != bare] if first.endswith(".") and len(bare) >= 3 else None
        if stands is None and bare not in GIVEN:
            stands = SHORT.get(bare)
        given = [] if stands else meant(bare, GIVEN, NEAR_GIVEN)
        if stands or len(given) > 1:
            stands = stands or given
            return {
                "key": f"p {stands[0]} {last}", "exact": [f"g {g} {last}" for g in stands], "near": [f"g {g} {d}" for g in stands for d in deletions(last)], "full": False,
            }
        if given:
            slips = [f"g {given[0]} {d}" for d in deletions(last)]
            return {
                "key": f"p {given[0]} {last}", "exact": [f"g {given[0]} {last}", f"i {given[0][0]} {last}"],
                "near": [*slips, *(f"i {given[0][0]} {d}" for d in deletions(last))], "full": True, "slips": slips,
            }
    return None


def readings(names: DataFrame) -> DataFrame:
    """(name, rows, key, full, open, exact, near, slips) of every name (name, rows) that is not blank; open are those of which no given name or form of organisation is known.

    Names with digits or back quotes are never a person's.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        def code(forms: list[str | int]) -> list[int]:
            return [(f if isinstance(f, int) else xxh3_64_intdigest(f)) - (1 << 63) for f in dict.fromkeys(forms)]

        for batch in batches:
            for start in range(0, len(batch), 1000):  # a name has some hundred forms
                part, rows = batch.iloc[start : start + 1000], []
                for name, n in zip(part["name"], part["rows"]):
                    text = plain(name)
                    if not text:
                        continue
                    marked = re.search(r"\d|`", text)
                    r = organisation(text) or (not marked and (person(text) or acronym(text))) or company(text) or anyone(text)
                    rows.append((name, n, r["key"], r["full"], r.get("open", False), code(r["exact"]), code(r["near"]), code(r.get("slips", []))))
                yield pd.DataFrame(rows, columns=["name", "rows", "key", "full", "open", "exact", "near", "slips"])

    ship(names.sparkSession)
    return names.select("name", "rows").mapInPandas(work, "name string, rows long, key string, full boolean, open boolean, exact array<long>, near array<long>, slips array<long>")


def meet(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """left joined to right by sorting both: Spark takes an exploded array for one value, and would broadcast tables many times as large as it believes."""
    return left.join(right.hint("merge"), on, how)


def one_slip(a: Column, b: Column) -> Column:
    """Whether two keys differ by one edit, or by two neighbours swapped."""
    away = F.levenshtein(a, b, 2)
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (away.between(0, 1)) | ((away == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def better_keys(forms: DataFrame, allowed: Column) -> DataFrame:
    """(key, rank, best): for keys (key, rank, form) every better ranked key (rank holds its key) that shares a form and is one slip away."""
    better = forms.select("form", F.col("rank").alias("best"))
    return meet(forms, better, "form").where((F.col("best") > F.col("rank")) & allowed & one_slip(F.col("key"), F.col("best.key"))).select("key", "rank", "best").distinct()


def open_keys(keys: DataFrame) -> DataFrame:
    """(key, entity, score): open keys that are a slip of one with more spellings, at least two, lead to that one, the others to themselves."""
    forms = keys.select("key", F.struct("support", "rows", "key").alias("rank"), F.explode("slips").alias("form"))
    found = better_keys(forms, (F.col("best.support") >= 2) & (F.col("best.support") > F.col("rank.support")))
    up = materialise(found.groupBy("key").agg(F.max("best").alias("best"), F.max("rank.support").alias("support")), "open-slips")
    score = (F.col("best.support") + 1) / (F.col("best.support") + F.col("support") + 1)
    up = meet(up, up.select(F.col("key").alias("mid")), F.col("best.key") == F.col("mid"), "left_anti").select("key", F.col("best.key").alias("entity"), score.alias("score"))
    return meet(keys.select("key"), up, "key", "left").select("key", F.coalesce("entity", "key").alias("entity"), F.coalesce("score", F.lit(1.0)).alias("score"))


def true_keys(keys: DataFrame) -> DataFrame:
    """(key, entity, score): keys that are a slip of a better supported key lead to that one, the others to themselves.

    A key ranks by how many keys share its least shared word, then by its
    spellings; a slip has at most two spellings, or a third of those of what it is a slip of. The word that differs must be no name of its own: every key that
    holds it must be such a slip of a key that holds the same other word instead.
    """
    parts = lambda c: F.split(c, " ")
    each = keys.select("key", F.explode(F.array_distinct(parts("key"))).alias("word")).where(~F.col("word").isin(*GIVEN, *LEGAL, "o", "p"))
    held = materialise(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    shared = meet(each, held, "word").groupBy("key").agg(F.min("n").alias("shared"))
    keys = materialise(meet(keys, shared, "key", "left"), "ranked")
    rank = F.struct(F.coalesce("shared", F.lit(0)).alias("shared"), "support", "rows", "key")
    forms = keys.select("key", rank.alias("rank"), F.explode("slips").alias("form"))
    found = better_keys(forms, (F.col("rank.support") <= 2) | (3 * F.col("rank.support") <= F.col("best.support")))
    differs = lambda a, b: F.get(F.array_except(parts(a), parts(b)), F.lit(0))
    score = (F.col("best.support") + 1) / (F.col("best.support") + F.col("rank.support") + 1)
    found = materialise(found.select("key", "best", score.alias("score"), differs("key", "best.key").alias("word"), differs("best.key", "key").alias("meant")), "found")
    slipped = found.groupBy("word", "meant").agg(F.count_distinct("key").alias("n"))
    rare = meet(slipped, held, ["word", "n"]).select("word", "meant")
    up = meet(found, rare, ["word", "meant"]).groupBy("key").agg(F.max(F.struct("best", "score")).alias("b")).select("key", F.col("b.best.key").alias("up"), "b.score")
    up = materialise(up, "slips")
    further = up.select(F.col("key").alias("up"), F.col("up").alias("up2"))
    up = meet(up, further, "up", "left").select("key", F.coalesce("up2", "up").alias("up"), "score")
    spelt = meet(meet(meet(keys.select("key"), up, "key", "left_anti"), each, "key"), true_words(held), "word")
    spelt = spelt.groupBy("key").agg(F.max(F.struct("word", "meant")).alias("w")).select("key", F.replace("key", "w.word", "w.meant").alias("spelt"))
    spelt = meet(spelt, keys.select(F.col("key").alias("spelt")), "spelt", "left_anti")
    roots = meet(keys, up, "key", "left").select("key", F.coalesce("up", "key").alias("root"), F.coalesce("score", F.lit(1.0)).alias("score"))
    return meet(roots, spelt.withColumnRenamed("key", "root"), "root", "left").select("key", F.coalesce("spelt", "root").alias("entity"), "score")


def true_words(held: DataFrame) -> DataFrame:
    """(word, meant): words of a single key that are one slip away from a word of several keys.

    So two slips in one name that is never spelt rightly still meet, as long as
    others bear the same family or house name.
    """
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    forms = held.where(F.length("word") >= 5).select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), cut))).alias("form"))
    best = forms.groupBy("form").agg(F.max(F.struct("n", "word")).alias("best")).where("best.n > 1")
    found = meet(forms.where("n = 1"), best, "form").where(one_slip(F.col("word"), F.col("best.word")))
    return found.groupBy("word").agg(F.max("best").alias("best")).select("word", F.col("best.word").alias("meant"))


def link_names(names: DataFrame, name: str = "name", least_score: float = 0.5) -> DataFrame:
    """(name, entity, score): every spelling of a name with the entity that it names.

    names holds one row per occurrence. Each distinct spelling is rewritten by
    rules for case, accents, titles, middle initials, token order, fillers and
    legal forms to a key; full names also rewrite to what others may call them:
    given name shortened or as an initial, field left out, cut or drawn into
    an acronym, and all of these with one letter missing. Forms are exploded and
    equi-joined. Known given names and forms of organisations add rewritings;
    names without them, of any number of words, are open: they meet by case,
    accents, order, titles and middle initials, by an initial if no known name
    has it, and by one slip if the other key has two spellings and more of them.
    A word with a digit or a back quote has no slips.

    score says how surely the spelling names the entity: 1 for a key of its own;
    for a slip the share of spellings that the better supported key has; for a
    short form the rarity of its rewriting, 1 over the number of entities that it
    may stand for (the exact rewritings first, then those with a letter missing).
    A short form is linked if its score is above least_score; others stay with
    their equals.

    Only distinct spellings are joined, so frequent names cost no more than
    rare ones, and forms meet grouped entities instead of each other. Nulls and
    blank strings give no rows.
    """
    counts = names.select(F.col(name).alias("name")).where(F.col("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    counts = materialise(counts, "spellings")
    read = materialise(readings(counts), "readings")
    by_key = read.where("full").groupBy("key", "open").agg(F.count(F.lit(1)).alias("support"), F.sum("rows").alias("rows"), *[F.first(c).alias(c) for c in ("exact", "near", "slips")])
    by_key = materialise(by_key, "keys")
    entity = materialise(true_keys(by_key.where("not open")).unionByName(open_keys(by_key.where("open"))), "entities")

    owners = materialise(meet(by_key, entity, "key").select("open", "entity", "exact", "near"), "owners")
    shorts = materialise(read.where("not full").groupBy("key").agg(*[F.first(c).alias(c) for c in ("exact", "near")]), "shorts")

    def reached(forms: str, open_names: bool) -> DataFrame:
        """(key, n, entity): how many entities a short key's forms lead to at least, and which one if there is only one."""
        owned = owners.where(F.col("open") == open_names).select("entity", F.explode(forms).alias("form"))
        owned = owned.groupBy("form").agg(F.min("entity").alias("low"), F.max("entity").alias("high"), F.count_distinct("entity").alias("n"))
        met = meet(shorts.select("key", F.explode(forms).alias("form")), owned, "form").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("n"))
        several = F.greatest(F.col("n"), F.lit(2))
        return met.select("key", F.when(F.col("low") == F.col("high"), F.lit(1)).otherwise(several).alias("n"), F.col("low").alias("entity"))

    met = None
    for place, (forms, open_names) in enumerate([("exact", False), ("near", False), ("exact", True), ("near", True)]):
        part = reached(forms, open_names).withColumn("place", F.lit(place))
        met = part if met is None else met.unionByName(part)
    chosen = met.groupBy("key").agg(F.min_by(F.struct("n", "entity"), "place").alias("c")).select("key", F.col("c.entity").alias("meant"), (1 / F.col("c.n")).alias("rarity"))
    own = entity.select("key", F.col("entity").alias("own"))
    linked = F.col("rarity") > least_score
    full = meet(read.where("full").select("name", "key"), entity, "key").select("name", "entity", "score")
    short = meet(meet(read.where("not full").select("name", "key"), chosen, "key", "left"), own, "key", "left")
    short = short.select("name", F.when(linked, F.col("meant")).otherwise(F.coalesce("own", "key")).alias("entity"), F.coalesce("rarity", F.lit(1.0)).alias("score"))
    return full.unionByName(short)


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b) of every two different spellings of one entity, in code-point order."""
    met = met_in_blocks(materialise(linked.select("entity", F.col("name").alias("item")).distinct(), "linked"), ["entity"], hint="merge")
    return met.select(F.col("x").alias("name_a"), F.col("y").alias("name_b"))
