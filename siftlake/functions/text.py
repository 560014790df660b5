"""String functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence with its end marks, or end marks alone: the matches cover the whole text.
SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"
#: What a text that can't be told, or isn't allowed, gets as its language.
UNKNOWN = "unk"
#: Characters that language detection looks at.
DETECTED = 100
#: Runs of Unicode's white space.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Frequent words of languages.
COMMON = {
    "de": "der die das und ist nicht mit ein eine von zu den im auf für dem sich",
    "en": "the of and to in is that for it as with was on by are this be",
    "es": "el los las una que por con para del se no al su es lo como más",
    "fr": "le les des et une est dans que pour pas sur au qui par il ne ce",
    "it": "il gli della che di un per non sono con del alla anche come più nel si",
    "ro": "și în de la cu este pe nu mai sau din care pentru fi au ca un",
}
#: Prefixes of model inputs by model, mode and, where it matters, the requested language.
PREFIXES = {
    ("arctic", "search"): "query: ",
    ("jina", "search"): "Query: ",
    ("jina", "store"): "Document: ",
}
#: Instructions of the instruct model by requested language.
INSTRUCTIONS = {
    "auto": "Given a web search query, retrieve relevant passages that answer the query",
    "en": "Given a web search query, retrieve relevant passages that answer the query",
    "fr": "Étant donné une requête de recherche web, récupérez les passages pertinents qui répondent à la requête",
    "de": "Angenommen, eine Web-Suchanfrage, rufen Sie relevante Passagen ab, die die Anfrage beantworten",
    "es": "Dada una consulta de búsqueda web, recupere los pasajes relevantes que respondan a la consulta",
    "it": "Data una query di ricerca web, recupera i passaggi rilevanti che rispondono alla query",
    "ro": "Având o interogare de căutare web, recuperați pasajele relevante care răspund la interogare",
}


def sentences(text: Column) -> Column:
    """The pieces of a text; together they are the text."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def detection_text(text: Column) -> Column:
    """What language detection sees: lower case, single spaces, the first characters up to the last space among them."""
    plain = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+", " "), 1, DETECTED)
    return F.when(plain.contains(" "), F.regexp_extract(plain, r"^(.*) ", 1)).otherwise(plain)


def head(text: Column, most: int = 4 * DETECTED) -> Column:
    """A text up to its `most`-th character that is no white space: what detection sees of it is the same."""
    return F.regexp_extract(text, rf"^(?:\s*+\S){{0,{most}}}+", 0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def detected(text: Column) -> Column:
    """(language, score) of what detection_text keeps of a text: of the languages of COMMON, the one with the most of its
    words, ties by name, and its words' share of all languages' words. A model's detector can take its place."""

    def best(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda n, x: n + x["n"])
        first = F.array_sort(counts, lambda x, y: F.when(x["n"] != y["n"], y["n"] - x["n"]).when(x["language"] < y["language"], -1).otherwise(1))[0]
        return F.struct(F.when(total > 0, first["language"]).alias("language"), F.when(total > 0, first["n"] / total).otherwise(0.0).alias("score"))

    among = lambda words, own: F.size(F.filter(words, lambda w: w.isin(own.split())))
    counts = lambda words: F.array(*[F.struct(among(words, own).alias("n"), F.lit(name).alias("language")) for name, own in COMMON.items()])
    return bound(F.split(detection_text(head(text)), r"[^\p{L}]+"), lambda words: bound(counts(words), best))


def language_rule(requested: Column, detected: Column, score: Column, allowed: list[str], least: float = 0.2) -> Column:
    """The requested language if allowed; for `auto` the detected one if sure enough and allowed; else unknown."""
    found = F.when((score >= least) & detected.isin(allowed), detected).otherwise(UNKNOWN)
    return F.when(requested == "auto", found).when(requested.isin(allowed), requested).otherwise(UNKNOWN)


def lemma(token: Column) -> Column:
    """A token of an unknown language: lower case, without marks, punctuation, symbols and separators at its ends."""
    bare = F.regexp_replace(F.lower(token), r"^[\p{M}\p{P}\p{S}\p{Z}\p{C}]+|[\p{M}\p{P}\p{S}\p{Z}\p{C}]+$", "")
    return F.when(bare == "", F.lit("<unk>")).otherwise(bare)


def tokens(text: Column) -> Column:
    """White-space tokens, by the white space of Unicode."""
    return F.array_remove(F.split(text, SPACES), "")


def model_input(text: Column, model: str, mode: str, language: Column) -> Column:
    """The text with the model's prefix for the mode."""
    if model == "e5" and mode == "search":
        table = F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv])
        return F.concat(F.lit("Instruct: "), F.coalesce(F.try_element_at(table, language), F.lit(INSTRUCTIONS["auto"])), F.lit("\nQuery: "), text)
    return F.concat(F.lit(PREFIXES.get((model, mode), "")), text)


def truncated(text: Column, most: int = 256, head: int = 250, tail: int = 3) -> Column:
    """For logs: long texts as their beginning, three dots and their end."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit("..."), F.right(text, F.lit(tail)))).otherwise(text)


def slug(text: Column, digits: bool = False) -> Column:
    """Lower case, other characters than letters (and digits) as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+" if digits else "[^a-z]+", "_"), F.lit("_"))


def locale(code: Column) -> Column:
    """Lower case up to the underscore, upper case from there on."""
    at = F.instr(code, "_")
    return F.when(at > 0, F.concat(F.lower(F.substring(code, F.lit(1), at - 1)), F.upper(F.substring(code, at, F.length(code))))).otherwise(F.lower(code))


def series(code: Column) -> Column:
    return F.regexp_replace(code, "[^A-Z]", "")


def number(code: Column) -> Column:
    return F.regexp_replace(code, "[^0-9]", "").try_cast("bigint")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """Each {key} replaced by its value."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), value)
    return template


def headers(comment: Column) -> Column:
    """`key: value` lines of a comment block as a map; the last of equal keys stays."""
    lines = F.regexp_extract_all(comment, F.lit(r"(?m)^[ \t/*#@]*([A-Za-z][A-Za-z0-9 _-]*):[ \t]*(.*)$"), F.lit(0))
    key = lambda x: F.lower(F.trim(F.regexp_extract(x, r"([A-Za-z][A-Za-z0-9 _-]*):", 1)))
    value = lambda x: F.trim(F.regexp_extract(x, r":[ \t]*(.*)$", 1))
    return F.aggregate(lines, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != key(x)), F.create_map(key(x), value(x))))


def decoded(data: Column) -> Column:
    """Bytes as UTF-8, or as base64 where they aren't."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.base64(data))


def html_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags; the five entities read; white space as one space."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
