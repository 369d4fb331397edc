"""Text functions as Column expressions; Python only where no built-in expresses the rule."""

from __future__ import annotations

import unicodedata
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English words that text search leaves out.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your"
).split()


def slugify(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def blank_wildcards(text: str) -> str:
    """A user's search text without the wildcards of LIKE."""
    return "".join(" " if c in "%_\\" else c for c in text).strip()


def humanise(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit(" "))


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def paragraphs(text: Column) -> Column:
    """Parts between runs of two or more line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")


def surname(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def bare_doi(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://(dx\.)?doi\.org/", "")


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def clean(text: Column) -> Column:
    """Without NUL characters and with invalid UTF-8, as of unpaired surrogates, replaced."""
    return F.make_valid_utf8(F.regexp_replace(text, r"\x00", ""))


def cleaned(value: Column, kind: T.DataType) -> Column:
    """clean() on every string inside a value of the type: in arrays, structs and the values and keys of maps."""
    if isinstance(kind, T.StringType):
        return clean(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: cleaned(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(cleaned(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(value, lambda k, v: cleaned(k, kind.keyType)), lambda k, v: cleaned(v, kind.valueType))
    return value


def url_decoded(text: Column) -> Column:
    """A URL component decoded, in which a plus sign is itself; null where it is malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def url_encoded(text: Column) -> Column:
    """A text as a URL component, spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def embedding_text(name: Column, short: Column, summary: Column, limit: int = 8000) -> Column:
    return F.substring(F.concat_ws(" ", F.concat(name, F.lit(".")), short, summary), 1, limit)


def rough_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3)


def accent_classes() -> dict[str, str]:
    """ASCII letter -> the letters up to U+024F that compatibility decomposition turns into it and combining marks."""
    found = defaultdict(list)
    for point in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFKD", chr(point))
        if len(parts) > 1 and parts[0].isascii() and parts[0].islower() and all(unicodedata.combining(c) for c in parts[1:]):
            found[parts[0]].append(chr(point))
    return {letter: "".join(others) for letter, others in sorted(found.items())}


def significant_words(text: Column) -> Column:
    """Distinct words of more than three letters a-z or digits; an accent ends a word, as a decomposed mark would."""
    classes = accent_classes()
    accented, plain = "".join(classes.values()), "".join(letter * len(others) for letter, others in classes.items())
    text = F.translate(F.regexp_replace(F.lower(text), f"([{accented}])", "$1 "), accented, plain)
    words = F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))


def word_overlap(a: Column, b: Column) -> Column:
    """Common words as a share of the smaller of two word sets; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def lexemes(text: Column) -> Column:
    """Words a-z and 0-9 in order, in lower case, without stop words."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def trigrams(text: Column) -> Column:
    """The ordered trigrams of the words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def word_similarity(query: Column, text: Column) -> Column:
    """The greatest similarity of the query's trigram set to that of any extent of the text's ordered trigrams."""
    asked, held = F.array_distinct(trigrams(query)), trigrams(text)

    def best_from(start: Column) -> Column:
        def score(stop: Column) -> Column:
            extent = F.slice(held, start, stop - start + 1)
            return F.size(F.array_intersect(asked, extent)) / F.size(F.array_union(asked, extent))

        return F.array_max(F.transform(F.sequence(start, F.size(held)), score))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(held)), best_from))
    return F.when((F.size(asked) > 0) & (F.size(held) > 0), best).otherwise(F.lit(0.0))


def trigram_overlap(query: Column, text: Column) -> Column:
    """Share of the query's trigrams that stand in the text; never less than word_similarity, so a filter before it."""
    asked = F.array_distinct(trigrams(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, trigrams(text))) / F.size(asked)).otherwise(F.lit(0.0))
