"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that bear no meaning in a search. Fixed values.
STOPWORDS = """
a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought
used to of in for on with at by from as into through during before after above below between out off over under again further
then once here there when where why how all both each few more most other some such no nor not only own same so than too very
just because but and or if while about up that this these those it its he she they them his her their what which who whom we
you i me my your our also however although
""".split()
#: Capitalised words that are no names, and capitals that are no acronyms. Fixed values.
COMMON_CAPITALISED = """
The This That These Those There Their They Then When Where What Which While However Although Because Since After Before During
Between Through About Into From Over Under Some Many Most Each Every Both Such Other Another Several Also Often Sometimes
Usually Today Here Now
""".split()
COMMON_ACRONYMS = "I II III IV V VI AM PM AD BC CE BCE VS EG IE OK".split()
#: An edge of an ASCII word: Java's own is an edge of a Unicode word.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
STRUCTURAL = ["document", "section"]


def edged(pattern: str) -> str:
    """A pattern between two edges of ASCII words."""
    return f"{EDGE}{pattern}{EDGE}"


def tokens(text: Column) -> Column:
    """The terms of a text: lower-case runs of ASCII letters and digits of two or more, without stop words."""
    return F.filter(words(text), is_term)


def words(text: Column) -> Column:
    """The lower-case runs of ASCII letters and digits of a text; empty strings may stand at the ends."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def is_term(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(STOPWORDS)


def sentences(text: Column) -> Column:
    """The sentences of a text, cut after . ! or ? and white space; blank ones left out."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    """The stretches between blank lines, blank ones left out."""
    return F.filter(F.split(text, r"\n\n+"), lambda p: F.regexp_replace(p, r"\s+", "") != "")


def stripped(text: Column) -> Column:
    """A text without the white space around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def packed_sentences(text: Column, most_sentences: int = 3, most_chars: int = 500) -> Column:
    """A long paragraph as chunks: sentences are added until there are three or the chunk exceeds 500 characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(state: Column, sentence: Column) -> Column:
        now = F.when(state["n"] == 0, sentence).otherwise(F.concat(state["now"], F.lit(" "), sentence))
        full = (state["n"] + 1 >= most_sentences) | (F.length(now) > most_chars)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"),
            F.when(full, F.lit("")).otherwise(now).alias("now"),
            F.when(full, F.lit(0)).otherwise(state["n"] + 1).alias("n"),
        )

    def close(state: Column) -> Column:
        return F.when(state["n"] > 0, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"])

    return F.transform(F.aggregate(sentences(text), start, add, close), stripped)


def chunks(text: Column, most_chars: int = 500) -> Column:
    """The chunks of a text: its paragraphs, long ones packed from their sentences."""
    part = lambda p: F.when(F.length(p) <= most_chars, F.array(stripped(p))).otherwise(packed_sentences(p, most_chars=most_chars))
    return F.flatten(F.transform(paragraphs(text), part))


def chunk_type(text: Column) -> Column:
    """definition, event, data-point, claim or fact: the first whose cue the text has."""
    low = F.lower(text)
    return (
        F.when(low.rlike(edged("(is defined as|refers to|is a|is an|means)")) & (F.length(text) < 200), "definition")
        .when(low.rlike(edged(r"(in [0-9]{4}|on [A-Za-z0-9_]+ [0-9]{1,2}|founded|invented|created|launched|discovered)")), "event")
        .when(low.rlike(edged(r"([0-9]+%|\$[0-9,.]+|[0-9,.]+\s*(million|billion|thousand))")), "data-point")
        .when(low.rlike(edged("(according to|studies show|research suggests|it is believed)")), "claim")
        .when(text.isNotNull(), "fact")
    )


def correction_type(text: Column) -> Column:
    """The node type of a correction written by a person."""
    low = F.lower(text)
    return (
        F.when(low.rlike(edged("(is defined as|refers to|means)")), "definition")
        .when(low.rlike(edged("(in [0-9]{4}|founded|invented|created)")), "event")
        .when(low.rlike(edged("(should|must|prefer|always|never)")), "preference")
        .when(text.isNotNull(), "fact")
    )


def entities(text: Column) -> Column:
    """The names in a text: capitalised phrases, capitalised words after the first, years, acronyms and code, each once."""
    phrases = F.regexp_extract_all(text, F.lit(edged(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)")), F.lit(1))
    words = F.split(text, r"\s+")
    later = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    named = F.filter(later, lambda w: (F.length(w) > 2) & w.rlike("^[A-Z][a-z]+$") & ~w.isin(COMMON_CAPITALISED))
    years = F.regexp_extract_all(text, F.lit(edged("(1[0-9]{3}|20[0-2][0-9])")), F.lit(1))
    acronyms = F.filter(F.regexp_extract_all(text, F.lit(edged("([A-Z]{2,})")), F.lit(1)), lambda a: ~a.isin(COMMON_ACRONYMS))
    code = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    return F.array_distinct(F.concat(phrases, named, years, acronyms, code))


def links(text: Column) -> Column:
    """The targets of markdown links and of double brackets."""
    inline = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(2))
    return F.concat(inline, F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))


def defined_term(text: Column) -> Column:
    """What a definition defines, by the first pattern that fits; null if none does."""
    patterns = [r"(?i)^(.+?)\s+is\s+defined\s+as", r"(?i)^(.+?)\s+refers?\s+to", r"(?i)^(.+?)\s+is\s+(?:a|an|the)\s", r"(?i)^(?:a|an|the)\s+(.+?)\s+is\s"]
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def string_hash(text: Column) -> Column:
    """The 32-bit multiply-by-33 hash of a text's characters, in base 36; for characters up to U+FFFF.

    Parity function only: 32 bits collide, so content is compared by sha2.
    """
    code = F.aggregate(F.split(text, ""), F.lit(5381).cast("long"), lambda a, c: F.when(c == "", a).otherwise((a * 33 + F.ascii(c)).bitwiseAND(F.lit(4294967295))))
    signed = F.when(code >= 2147483648, code - 4294967296).otherwise(code)
    return F.concat(F.when(signed < 0, "-").otherwise(""), F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)))


def content_hash(text: Column) -> Column:
    """What equal contents share."""
    return F.sha2(text, 256)


def likely_person(name: Column) -> Column:
    """Whether a name has two or more capitalised words and nothing else."""
    return name.rlike(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)+$")


def one_spaced(name: Column) -> Column:
    return F.regexp_replace(stripped(name), r"\s+", " ")


def first_year(text: Column) -> Column:
    """The first year from 1000 to 2029 in a text."""
    return F.nullif(F.regexp_extract(text, edged("(1[0-9]{3}|20[0-2][0-9])"), 1), F.lit("")).try_cast("int")


def slug(text: Column) -> Column:
    """A text as part of an address."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]*>", ""))


#: Number words up to twelve. Fixed values.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()


def first_number(text: Column) -> Column:
    """The first number of a text in digits, else its first number word; null if there is none."""
    digits = F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    word = F.regexp_extract(F.lower(text), edged("(" + "|".join(NUMBER_WORDS) + ")"), 1)
    return F.coalesce(digits, reduce(lambda c, i: c.when(word == NUMBER_WORDS[i], float(i)), range(1, 13), F.when(word == "zero", 0.0)))


def day_tag(date: Column) -> Column:
    """A written date as YYYY-MM-DD (Dow); null where there is none."""
    found = F.regexp_extract(date, r"([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", 0)
    day = F.try_to_date(F.regexp_replace(found, "/", "-"), "yyyy-M-d")
    return F.when(found != "", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" ("), F.date_format(day, "EEE"), F.lit(")")))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def same_case(names: Column) -> Column:
    return F.array_distinct(F.transform(names, F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """The shared part of two name lists, without regard to case; 0 if both are empty."""
    a, b = same_case(a), same_case(b)
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def dense_cosine(a: Column, b: Column) -> Column:
    """The cosine of two number arrays over their common length; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def six(x: Column) -> Column:
    """A number to six decimals, halves up, by the same steps in every engine."""
    return F.floor(x * 1000000 + 0.5) / 1000000


def domain(file: Column) -> Column:
    """The kind of source that a file name begins with."""
    return F.substring_index(file, ":", 1)


def confidence_trend(mean: Column) -> Column:
    return F.when(mean > 0.8, "stable").when(mean > 0.5, "rising").otherwise("decaying")
