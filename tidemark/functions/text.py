"""Tokenizers and small text functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no meaning in a query
STOPWORDS = tuple(
    "a an and are as at be but by can do does for from had has have how i if in into is it its me my no not of on or our should so than that the their them then there these they this to use used uses using was we were what when where which while who why will with would you your".split()
)
MIN_TERM = 3


def terms(text: Column) -> Column:
    """Terms of a text or name: camel case and acronyms split, lower case, words of 3 letters or more, no stopwords."""
    t = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.split(F.lower(t), "[^a-z0-9]+")
    return F.filter(parts, lambda w: (F.length(w) >= MIN_TERM) & ~w.isin(*STOPWORDS))


def words(text: Column) -> Column:
    """Words of a text as written, split at anything but ASCII letters, digits and the underscore; lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """A light stem: -ies to y, else -es after a sibilant, else -s; then one of -ment, -ing, -ed; then a last e.

    An ending goes only where three letters remain before it, a last e from words longer than three.
    """
    w = word
    plural = F.when(w.rlike("^.{3,}ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(ss|x|z|ch|sh)es$"), F.when(F.length(w) >= 5, F.regexp_replace(w, "es$", "")).otherwise(w))
    w = plural.when(w.rlike("^.{3,}s$") & ~w.rlike("(ss|us|is)$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    w = F.regexp_replace(w, "^(.{3,}?)(ment|ing|ed)$", "$1")
    return F.when(F.length(w) > 3, F.regexp_replace(w, "e$", "")).otherwise(w)


def query_terms(text: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Distinct terms of a query with the synonyms of each; a query of stopwords alone keeps its words."""
    t = terms(text)
    t = F.when(F.size(t) > 0, t).otherwise(words(text))
    if synonyms:
        more = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
        t = F.flatten(F.transform(t, lambda w: F.concat(F.array(w), F.coalesce(more[w], F.array().cast("array<string>")))))
    return F.array_distinct(t)


def alias_rewrite(text: Column, aliases: dict[str, str]) -> Column:
    """A query with the expansion of every alias appended that stands in it as a whole word, case and all."""
    import re as _re

    parts = [F.when(text.rlike(rf"(?<!\w){_re.escape(a)}(?!\w)"), F.lit(e)) for a, e in aliases.items()]
    return F.concat_ws(" ", text, *parts) if parts else text


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def grounded(quote: Column, source: Column) -> Column:
    """'grounded' if the quote stands in the source up to white space, 'unsupported' without a quote, else 'ungrounded'."""
    q = collapse(quote)
    return F.when(F.coalesce(q, F.lit("")) == "", "unsupported").when(F.coalesce(F.contains(collapse(source), q), F.lit(False)), "grounded").otherwise("ungrounded")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def glob_regex(glob: str) -> str:
    """An anchored pattern for a glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]), i + 1
    return f"^{out}$"


def compact_signature(signature: Column, width: int = 240) -> Column:
    """A signature without comments, on one line, at most ``width`` characters."""
    s = F.regexp_replace(signature, r"(?s)/\*.*?\*/", " ")
    return F.substring(collapse(F.regexp_replace(s, r"//[^\n]*", " ")), 1, width)


def canonical_json(json: Column) -> Column:
    """A JSON text with its keys in order and no white space; null where it does not parse."""
    return F.to_json(F.try_parse_json(json))


def etag(json: Column) -> Column:
    """A digest of a JSON text that does not change with the order of keys or white space."""
    return F.sha2(canonical_json(json), 256)


# fixed values: short forms of negations, and words that negate
_SHORT = (("can't", "can not"), ("cannot", "can not"), ("won't", "will not"), ("shan't", "shall not"), ("ain't", "is not"))
_NEGATIONS = r"\b(?:not|no|never|none|nothing|nobody|neither|nor|without)\b"


def expand_negation(text: Column) -> Column:
    """Short forms such as "don't" written out, in lower case."""
    t = F.regexp_replace(F.lower(text), "’", "'")
    for short, full in _SHORT:
        t = F.regexp_replace(t, rf"\b{short}\b", full)
    return F.regexp_replace(t, r"\b([a-z]+)n't\b", "$1 not")


def negated(text: Column) -> Column:
    return expand_negation(text).rlike(_NEGATIONS)


def without_negation(text: Column) -> Column:
    """The words of a text but for its negations, so that a claim and its denial meet."""
    return collapse(F.regexp_replace(F.regexp_replace(expand_negation(text), r"\b(?:does|do|did) not\b", "not"), _NEGATIONS, " "))


def expression_form(expr: Column) -> Column:
    """An expression as it is compared: lower case, one spelling of equal and not-equal, no blanks around signs, no outer parentheses."""
    e = F.lower(collapse(expr))
    e = F.regexp_replace(e, "<>|!==", "!=")
    e = F.regexp_replace(e, "===?", "=")
    e = F.regexp_replace(e, r"\s*([^\w\s'\"]+)\s*", "$1")
    e = F.regexp_replace(e, ";+$", "")
    return F.when(e.rlike(r"^\([^()]*\)$"), F.regexp_replace(e, r"^\(|\)$", "")).otherwise(e)
