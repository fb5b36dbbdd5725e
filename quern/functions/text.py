"""Text functions as columns: tokens, summaries, names, snippets, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of the index (a list of our own).
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself "
    "just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()

#: Frequent short words by language (lists of our own), for the vote of detected_language().
COMMON_WORDS = {
    "en": "the of and to in is that it was for on are with as be at this by from or an not but have had they which you were her all she there would their we him been has when who will more no if out so".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "le de la et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux cette mais comme nous leur ont".split(),
    "es": "de la que el en y los se del las un por con una su para es al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre".split(),
}
#: Characters of a text that are judged (a fixed value).
LANGUAGE_SAMPLE = 1000

# File types that are left out of names
FILE_TYPES = ("png", "svg", "ico", "gif", "jpeg", "jpg")
# Parts of URLs that are no terms
POPULAR_DOMAINS = tuple(
    "com org net edu gov mil int biz info name pro xyz online site shop store blog news media art film game games tech app dev ai cloud io co me tv ly to fm wiki help us uk ca au de fr jp cn ru br in cl mx es it nl se no fi dk pl be ch at nz za sg hk kr id my ph th vn il sa ae tr eg ar co pe ve pk ng ke tz ro "
    "en es fr de it pt nl ru zh ja ko ar tr pl sv no da fi el cs hu ro he th id ms hi bn ur vi google facebook instagram twitter tiktok linkedin youtube reddit wikipedia yahoo bing microsoft apple amazon ebay netflix hulu spotify pinterest snapchat discord steam github gitlab bitbucket twitch paypal stripe wordpress tumblr medium quora stackoverflow dropbox icloud adobe salesforce slack zoom airbnb uber lyft doordash tesla openai nvidia amd intel samsung huawei xiaomi sony bbc cnn nytimes forbes bloomberg wsj reuters".split()
)
# Fixed value: URLs in free text
URL_IN_TEXT = "https?://[^\\s<>()\\[\\]{}\"']+"

WORD = "[a-z0-9]+"


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _common(words: Column, of: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*of)))


def detected_language(text: Column) -> Column:
    """The language most of whose common words stand in the first LANGUAGE_SAMPLE characters; ties go to the first of COMMON_WORDS, null without any."""
    found = F.regexp_extract_all(F.lower(F.left(text, F.lit(LANGUAGE_SAMPLE))), F.lit("\\p{L}+"), F.lit(0))
    votes = F.transform(F.array(found), lambda w: F.array(*(_common(w, own) for own in COMMON_WORDS.values())))[0]
    best = F.element_at(F.array(*map(F.lit, COMMON_WORDS)), F.array_position(votes, F.array_max(votes)).cast("int"))
    return F.when(F.array_max(votes) > 0, best)


def index_terms(tokens: Column) -> Column:
    """Tokens that are letters and digits of any script and no stop words, in lower case; repeats stay."""
    return F.filter(F.transform(tokens, F.lower), lambda t: t.rlike("^[\\p{L}\\p{N}]+$") & ~t.isin(*STOP_WORDS))


def paragraph_text(paragraphs: Column) -> Column:
    """Paragraphs without [...] on one line, trimmed, joined by a space."""
    return F.array_join(F.transform(F.coalesce(paragraphs, F.array().cast("array<string>")), lambda p: F.regexp_replace(F.regexp_replace(p, "\\[.*?\\]", ""), "^\\s+|\\s+$", "")), " ")


def summary(text: Column, n: int = 500) -> Column:
    """The first n words, joined by a space."""
    return F.array_join(F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\S+"), F.lit(0)), 1, n), " ")


def split_name(name: Column) -> Column:
    """Words of a file name in lower case, without file types and parts with px."""
    parts = F.transform(F.split(name, "[-_./\\s]+"), F.lower)
    return F.filter(parts, lambda p: (p != "") & ~p.isin(*FILE_TYPES) & ~p.contains("px"))


def split_url(url: Column) -> Column:
    """Words of a URL in lower case, without common domains."""
    parts = F.transform(F.split(url, "[.,\\-_/+:()]"), F.lower)
    return F.filter(parts, lambda p: (p != "") & ~p.isin(*POPULAR_DOMAINS))


def boosted(tf: Column, times: Column) -> Column:
    """A term's weight when the URL has it so many times: 50-fold for each; an unseen term starts at 10. Doubles, as it can be huge."""
    seen = F.coalesce(tf, F.lit(0)) > 0
    return F.when(times == 0, tf.cast("double")).when(seen, tf.cast("double") * F.pow(F.lit(50.0), times)).otherwise(F.lit(10.0) * F.pow(F.lit(50.0), times - 1))


def filename(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def extension(name: Column) -> Column:
    """What follows the last dot, if something stands before it."""
    return F.regexp_extract(name, "[^./]\\.([^./]*)$", 1)


def query_terms(q: Column) -> Column:
    """Distinct terms of a query: '+' is a space, lower case, blanks dropped."""
    return F.array_distinct(F.filter(F.split(F.lower(F.replace(q, F.lit("+"), F.lit(" "))), " "), lambda t: t != ""))


def snippet(text: Column, most: int = 100) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def slug(text: Column, default: str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def compact_count(n: Column) -> Column:
    """12.3K, 4.5M, 1B: one decimal at most, cut."""
    def cut(unit: int, sign: str) -> Column:
        tenths = F.floor(n * 10 / unit)
        return F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))), F.lit(sign))

    return F.when(n >= 1_000_000_000, cut(1_000_000_000, "B")).when(n >= 1_000_000, cut(1_000_000, "M")).when(n >= 1000, cut(1000, "K")).otherwise(n.cast("string"))


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0))


def string_list(json: Column) -> Column:
    """A JSON array of strings; null if it is none."""
    return F.from_json(json, "array<string>")


def rfc1123(text: Column) -> Column:
    """A time such as Mon, 02 Jan 2006 15:04:05 GMT; null if it is none."""
    return F.try_to_timestamp(F.substring(text, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
