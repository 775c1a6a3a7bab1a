"""Scalar functions on text as Column expressions. Null in gives null out unless said
otherwise; white space is ASCII white space."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DETERMINERS = "the a an this these those that some any each every both all its their our my your his her".split()
GENERIC_LEADS = (
    "important significant major minor key main primary secondary general specific various different certain large small "
    "high low great little much many new old recent current modern traditional common similar same other additional further "
    "potential overall total local global natural human direct indirect positive negative physical chemical biological such "
    "single multiple several few number"
).split()
GENERIC_TAILS = (
    "role factor impact effect level amount rate way number type form part use result change example case point aspect "
    "feature process problem issue area region site location period time year study research work approach method analysis"
).split()
UMBRELLA_WORDS = (
    "systems processes activities principles organisms functions mechanisms environments conditions factors interactions "
    "resources habitats populations communities dynamics variations changes effects impacts"
).split()
SKIP_SECTIONS = ["References", "Further reading", "External links", "See also", "Notes", "Citations", "Bibliography", "Footnotes", "Gallery"]
#: Words that end a candidate phrase, by language.
STOP_WORDS = {
    "en": "the a an of in and or for to with by is are was were be it this that as on at from not".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder in im von vom zu zum zur mit auf für ist sind war nicht als auch es an bei aus".split(),
    "fr": "le la les l un une des du de d et ou en dans pour par avec sur est sont était ne pas que qui ce cette à au aux il elle".split(),
    "es": "el la los las un una unos unas de del y o en para por con sobre es son era no que se su al lo como más".split(),
}
LICENSES = {
    "attribution-noncommercial-noderivatives": "CC BY-NC-ND",
    "attribution-noncommercial-sharealike": "CC BY-NC-SA",
    "attribution-noncommercial": "CC BY-NC",
    "attribution-noderivatives": "CC BY-ND",
    "attribution-sharealike": "CC BY-SA",
    "attribution": "CC BY",
    "public domain": "Public Domain",
    "cc0": "CC0",
}
#: Lower-case letters with accents and the ASCII letters that they decompose to.
_DECOMPOSED = [(c, d[0]) for c, d in ((chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(128, 0x2000)) if c == c.lower() and d[0].isascii() and d[0].isalpha()]
ACCENTED, PLAIN = map("".join, zip(*_DECOMPOSED, strict=True))


def slugify(name: Column) -> Column:
    """Lower case, accents off, other characters than a-z 0-9 space and - dropped, spaces to -."""
    low = F.lower(name)
    plain = F.translate(low, ACCENTED, PLAIN)
    full = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s-]", ""), r"^\s+|\s+$", ""), r"\s+", "-")
    # most names are plain words with one blank between them; the group is possessive, as else each word is a call on the stack
    return F.when(low.rlike(r"\A[a-z0-9]++(?: [a-z0-9]++)*+\z"), F.translate(low, " ", "-")).otherwise(full)


def tokens(text: Column) -> Column:
    """Words between white space; none for blank text."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def capitalise(name: Column) -> Column:
    """First letter of each word up, the rest down; words all in capitals stay."""
    return F.array_join(
        F.transform(tokens(name), lambda w: F.when((w == F.upper(w)) & (w != F.lower(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))),
        " ",
    )


def strip_determiner(name: Column) -> Column:
    return F.regexp_replace(name, f"(?i)^({'|'.join(DETERMINERS)})\\s+", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def strip_tags(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments out, tags out, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return collapse(F.regexp_replace(bare, "<[^>]+>", " "))


def is_stop_word(word: Column, lang: Column) -> Column:
    """Whether a lower-case word is a stop word of a language, of English for any other."""
    out = F
    for k, words in STOP_WORDS.items():
        if k != "en":
            out = out.when(lang == k, word.isin(words))
    return out.otherwise(word.isin(STOP_WORDS["en"]))


def page_summary(extract: Column, length: Column, least: int = 80) -> Column:
    """{description, difficulty} of a page's intro and length: its first two sentences of more than 20
    characters, cut at 500; null if they have fewer than `least`."""
    flat = F.regexp_replace(F.replace(F.coalesce(extract, F.lit("")), F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    kept = F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 20)
    text = F.array_join(F.slice(kept, 1, 2), " ")
    made = F.struct(F.substring(text, 1, 500).alias("description"), difficulty_from_length(F.coalesce(length, F.lit(0))).alias("difficulty"))
    return F.when(F.length(text) >= least, made)


def summary(text: Column, sentences: int = 2, least: int = 20, most: int = 500) -> Column:
    """The first sentences of more than `least` characters, joined and cut."""
    kept = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > least)
    return F.substring(F.array_join(F.slice(kept, 1, sentences), " "), 1, most)


def difficulty_from_length(n: Column) -> Column:
    return F.when(n < 5000, 1).when(n < 15000, 2).when(n < 40000, 3).when(n < 90000, 4).otherwise(5).cast("int")


def clamp_difficulty(d: Column, default: int = 3) -> Column:
    """1 to 5; null and 0 count as the default."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(F.nullif(d, F.lit(0)), F.lit(default)))).cast("int")


def tier_band(difficulty: Column) -> Column:
    d = F.coalesce(F.nullif(difficulty, F.lit(0)), F.lit(3))
    return F.when(d <= 2, 1).when(d == 3, 2).otherwise(3).cast("int")


def preview(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def chunks(text: Column, separator: str = r"\n{2,}", most: int = 3200, least: int = 200) -> Column:
    """Paragraphs packed in order into chunks of at most `most` characters (joints not
    counted; a longer paragraph stays whole); chunks below `least` characters are dropped."""
    paragraphs = F.filter(F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("size"))

    def step(a, p):
        n = F.length(p)
        full = (a["size"] > 0) & (a["size"] + n > most)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.when(full | (a["size"] == 0), p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p)).alias("cur"),
            F.when(full, n).otherwise(a["size"] + n).alias("size"),
        )

    packed = F.aggregate(paragraphs, start, step, lambda a: F.when(a["size"] > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    return F.filter(packed, lambda c: F.length(c) >= least)


def sections(text: Column) -> Column:
    """[{title, content}] of text with `== title ==` lines; the lead is Introduction."""
    heads = F.regexp_extract_all(text, F.lit(r"\n==+ *([^=\n]+?) *==+\n"), F.lit(1))
    parts = F.split(text, r"\n==+ *[^=\n]+? *==+\n")
    titles = F.concat(F.array(F.lit("Introduction")), heads)
    return F.transform(F.arrays_zip(titles.alias("title"), parts.alias("content")), lambda s: F.struct(s["title"].alias("title"), collapse(s["content"]).alias("content")))


def kept_sections(parts: Column) -> Column:
    """The lead with more than 50 characters; other sections with 60 that are not back matter."""
    lead = lambda s: (s["title"] == "Introduction") & (F.length(s["content"]) > 50)
    body = lambda s: (s["title"] != "Introduction") & ~s["title"].isin(SKIP_SECTIONS) & (F.length(s["content"]) >= 60)
    return F.filter(parts, lambda s: lead(s) | body(s))


def normalise_license(raw: Column) -> Column:
    """The short name of the longest licence fragment in the text, else the text trimmed."""
    low = F.lower(raw)
    first, *rest = LICENSES.items()
    out = F.when(low.contains(first[0]), first[1])
    for fragment, name in rest:
        out = out.when(low.contains(fragment), name)
    return out.otherwise(F.trim(raw))


def pick_url(formats: Column) -> Column:
    """Of [{type, url}] the first Online url, else the first PDF, else the first, else ''."""
    urls = F.filter(formats, lambda f: F.coalesce(f["url"], F.lit("")) != "")
    by = [F.get(F.filter(urls, _is(t)), F.lit(0))["url"] for t in ("Online", "PDF")]
    return F.coalesce(*by, F.get(urls, F.lit(0))["url"], F.lit(""))


def _is(kind: str):
    return lambda f: f["type"] == kind


def normalise_url(url: Column, prefix: str) -> Column:
    """http urls as they are, a bare handle behind the prefix, null for blank."""
    bare = F.trim(url)
    return F.when(bare.startswith("http"), bare).when(bare != "", F.concat(F.lit(prefix), bare))


def json_items(raw: Column, key: str, item: str) -> Column:
    """Items of model output: a JSON list, else the list under key, else that of the first
    key, else none. item is the items' DDL type."""
    as_list = F.from_json(raw, f"array<{item}>")
    as_map = F.from_json(raw, f"map<string,array<{item}>>")
    empty = F.array().cast(f"array<{item}>")
    return F.when(F.trim(raw).startswith("["), F.coalesce(as_list, empty)).otherwise(
        F.coalesce(F.try_element_at(as_map, F.lit(key)), F.get(F.map_values(as_map), F.lit(0)), empty)
    )


def marked_words(text: Column, lang: Column) -> Column:
    """Lower-case words with one blank between them, stop words of the language and marks as |, which
    also stands at both ends: words are letters of any script."""
    bare = collapse(F.regexp_replace(F.lower(text), r"[^\p{L}\s]+", " | "))
    words = F.transform(F.split(bare, " "), lambda w: F.when(is_stop_word(w, lang), "|").otherwise(w))
    return F.concat(F.lit("| "), F.array_join(words, " "), F.lit(" |"))


def phrase_candidates(docs: DataFrame, text: str, lang: str, least: int = 2, most: int = 6) -> DataFrame:
    """docs without text, a row for each distinct candidate `name` of each: runs of words between stop
    words of its language and marks, a leading determiner off, of `least` to `most` words, not a generic pair. Null
    and blank texts have none."""
    # one pattern finds the runs of the right length: conditions on rows would be evaluated for every run
    run = rf"(?<=\| )(?:(?:{'|'.join(DETERMINERS)}) (?!\|))?+([^ |]++(?: [^ |]++){{{least - 1},{most - 1}}}+)(?= \|)"
    found = F.regexp_extract_all(marked_words(F.col(text), F.col(lang)), F.lit(run), F.lit(1))
    named = docs.withColumn("name", F.explode(found)).drop(text)
    first, last = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    generic = first.isin(GENERIC_LEADS) & last.isin(GENERIC_TAILS) & (F.length("name") == F.length(first) + F.length(last) + 1)
    return named.filter(~generic).distinct()
