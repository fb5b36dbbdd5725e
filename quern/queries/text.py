"""Text, HTML and URL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.bindings import Tables
from quern.functions import text as T
from quern.functions import urls as U
from quern.functions.html import parse_pages
from quern.operators import indexing as I
from quern.operators import search as S
from quern.queries.registry import SPELL, query

# URLs with the cases that the normalisers treat differently
_RAW = "(SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '/' WHEN 1 THEN url || '#part' WHEN 2 THEN replace(url, '://', '://www.') WHEN 3 THEN upper(substr(url, 1, 12)) || substr(url, 13) WHEN 4 THEN replace(url, 'http', 'htp') ELSE url END AS u FROM {pages})"
_P = "regexp_extract(u, '^\\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$', {})"
_S, _A, _PATH, _QUERY = (_P.replace("{}", str(i)) for i in (1, 2, 3, 4))


def _raw(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.expr("CASE page_id % 6 WHEN 0 THEN concat(url, '/') WHEN 1 THEN concat(url, '#part') WHEN 2 THEN replace(url, '://', '://www.') WHEN 3 THEN concat(upper(substr(url, 1, 12)), substr(url, 13)) WHEN 4 THEN replace(url, 'http', 'htp') ELSE url END").alias("u"))


@query("UR1", f"SELECT page_id, lower({_S}) || '://' || {_A} || regexp_replace({_PATH}, '/$', '') AS link FROM {_RAW}")
def ur1(t: Tables) -> DataFrame:
    return _raw(t).select("page_id", U.stripped(F.col("u")).alias("link"))


@query("UR2", f"SELECT page_id, CASE WHEN lower({_S}) IN ('http', 'https') THEN regexp_replace({_A}, '^www\\.', '') || regexp_replace({_PATH}, '/$', '') END AS link FROM {_RAW}")
def ur2(t: Tables) -> DataFrame:
    return _raw(t).select("page_id", U.normalized(F.col("u")).alias("link"))


@query("UR3", f"SELECT page_id, CASE WHEN lower({_S}) IN ('http', 'https') THEN 'https://' || regexp_replace(lower({_A}), '^www\\.', '') || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || CASE WHEN contains({_QUERY}, 'page=2') THEN '?page=2' ELSE '' END END AS link FROM {_RAW}")
def ur3(t: Tables) -> DataFrame:
    return _raw(t).select("page_id", U.canonical(F.col("u")).alias("link"))


@query("UR4", "SELECT seq, CASE WHEN NOT contains(url, 'reddit.com') THEN regexp_replace(url, '[.,);\\]]+$', '') END AS link FROM {listing}")
def ur4(t: Tables) -> DataFrame:
    return t.listing.select("seq", U.canonical_outbound(F.col("url")).alias("link"))


@query("UR5", "SELECT page_id, regexp_replace(regexp_replace(url, '^https://', ''), '/+$', '') AS link FROM {pages} WHERE url LIKE 'https://%'")
def ur5(t: Tables) -> DataFrame:
    return t.pages.where("url like 'https://%'").select("page_id", U.page_key(F.col("url")).alias("link"))


@query("UR6", f"SELECT page_id, CASE WHEN {_S} IN ('http', 'https') THEN regexp_replace(lower({_A}), '^www\\.', '') || regexp_replace({_PATH}, '/+$', '') END AS link FROM {_RAW}")
def ur6(t: Tables) -> DataFrame:
    return _raw(t).select("page_id", U.spider_key(F.col("u")).alias("link"))


_UR7 = f"lower({_S}) || '://' || lower({_A}) || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || coalesce({_QUERY}, '')"


@query("UR7", f"SELECT page_id, CASE WHEN lower({_S}) IN ('http', 'https') THEN {_UR7} END AS source_url, CASE WHEN lower({_S}) IN ('http', 'https') THEN sha256({_UR7}) END AS source_url_hash FROM {_RAW}")
def ur7(t: Tables) -> DataFrame:
    return _raw(t).select("page_id", U.source_url(F.col("u")).alias("s")).select("page_id", "s.source_url", "s.source_url_hash")


_LINKS = "(SELECT DISTINCT page_id, url, regexp_extract(url, '^https?://[^/?#]+', 0) || regexp_replace(regexp_replace(h, '[?#].*$', ''), '/$', '') AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM {pages}) WHERE NOT regexp_matches(h, '[^\\x21\\x23-\\x3B\\x3D\\x3F-\\x7E]'))"
_BARE = "regexp_replace(regexp_replace(regexp_replace({}, '^https?://(www\\.)?', ''), '[?#].*$', ''), '/$', '')"


@query("UR8", f"SELECT page_id, link FROM {_LINKS}")
def ur8(t: Tables) -> DataFrame:
    return I.link_targets(parse_pages(t.pages)).select("page_id", "link")


@query("UR9", "SELECT page_id, count(DISTINCT h) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS h FROM {pages}) GROUP BY page_id")
def ur9(t: Tables) -> DataFrame:
    return parse_pages(t.pages).select("page_id", F.size(F.array_distinct("hrefs")).cast("bigint").alias("links")).where("links > 0")


@query("UR10", "SELECT page_id, '/i/' || (page_id % 7) || '.png' AS src, 'b' || page_id AS alt FROM {pages}")
def ur10(t: Tables) -> DataFrame:
    image = lambda alt: F.concat(F.lit('<img src="/i/'), F.col("page_id") % 7, F.lit(f'.png" alt="{alt}'), "page_id", F.lit('">'))
    return I.image_table(parse_pages(t.pages.withColumn("html", F.concat("html", image("a"), F.lit('<img alt="none">'), image("b")))))


@query("UR11", "SELECT seq, CASE WHEN url LIKE 'https://www.reddit.com%' OR url LIKE 'https://old.reddit.com%' THEN 'https://old.reddit.com' || regexp_replace(substr(url, 23), '/+$', '') || '/.json' END AS link FROM {listing}")
def ur11(t: Tables) -> DataFrame:
    return t.listing.select("seq", U.listing_json(F.col("url")).alias("link"))


@query("UR12", "SELECT seq, CASE WHEN seq % 3 < 2 THEN url ELSE 'https://b.example.org/r?url=' || url_encode(url) END AS link FROM {listing}")
def ur12(t: Tables) -> DataFrame:
    # a redirect, a plain URL, and a URL of another host that only looks like a redirect
    wrapped = lambda host: F.concat(F.lit(f"https://{host}/r?"), F.when(F.col("seq") % 2 == 0, "x=1&").otherwise(""), F.lit("url="), F.url_encode("url"))
    shown = F.when(F.col("seq") % 3 == 0, wrapped("Out.reddit.com")).when(F.col("seq") % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("https://b.example.org/r?url="), F.url_encode("url")))
    return t.listing.select("seq", U.unwrapped(shown).alias("link"))


@query("UR13", "SELECT seq FROM {listing} WHERE NOT contains(url, 'reddit.com')")
def ur13(t: Tables) -> DataFrame:
    from quern.sources.seeds import seed_rows

    rows = t.listing.select("seq", "url", F.lit("General").alias("category"), F.lit(3).alias("priority"), F.lit("").alias("title"), "score", "subreddit", F.col("seq").cast("string").alias("permalink"))
    return seed_rows(rows).select(F.col("listing.permalink").cast("bigint").alias("seq"))


@query("UR14", f"SELECT DISTINCT {_BARE.format('url')} AS src, {_BARE.format('link')} AS dst FROM {_LINKS} WHERE NOT contains(link, '%') AND {_BARE.format('url')} <> {_BARE.format('link')}")
def ur14(t: Tables) -> DataFrame:
    return I.page_edges(I.link_targets(parse_pages(t.pages)))


@query("FLT11", "SELECT page_id, NOT contains(u, 'w/index.php') AND NOT contains(u, '%') AND NOT regexp_matches(u, '[^\\x20-\\x7E]') AS ok FROM " + _RAW)
def flt11(t: Tables) -> DataFrame:
    return _raw(t).select("page_id", U.is_valid(F.col("u")).alias("ok"))


@query("FLT12", "SELECT doc_id, NOT regexp_matches(split_part(text, ' ', 2), '[^\\x21\\x23-\\x3B\\x3D\\x3F-\\x7E]') AS ok FROM {documents}")
def flt12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", U.is_admissible(F.split_part("text", F.lit(" "), F.lit(2))).alias("ok"))


def _fields(t: Tables) -> DataFrame:
    """Parsed pages; every other page says more about itself in its head."""
    tag = lambda kind, name, content: F.concat(F.lit(f'<meta {kind}="{name}" content="'), content, F.lit('">'))
    plain = tag("name", "title", F.concat(F.lit("n"), F.col("page_id")))
    more = F.concat(tag("property", "og:title", F.lit("first")), tag("property", "og:title", F.concat(F.lit("T"), F.col("page_id"))), tag("name", "description", F.concat(F.lit("D"), F.col("page_id") % 5)), tag("property", "og:url", F.concat(F.lit("u"), F.col("page_id"))))
    head = F.when(F.col("page_id") % 2 == 0, F.concat(plain, more)).otherwise(plain)
    return parse_pages(t.pages.withColumn("html", F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>")))))


@query("TX1", "SELECT page_id, len(regexp_extract_all(html, '<p[> ]')) AS paragraphs, CASE WHEN page_id % 2 = 0 THEN 4 ELSE 1 END::BIGINT AS metas, replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&') AS title_tag FROM {pages}")
def tx1(t: Tables) -> DataFrame:
    return _fields(t).select("page_id", F.size("paragraphs").cast("bigint").alias("paragraphs"), F.size("meta").cast("bigint").alias("metas"), "title_tag")


@query("TX2", "SELECT page_id, 'title' AS name, 'n' || page_id AS content FROM {pages} UNION ALL SELECT page_id, unnest(['og:title', 'description', 'og:url']), unnest(['T' || page_id, 'D' || (page_id % 5), 'u' || page_id]) FROM {pages} WHERE page_id % 2 = 0")
def tx2(t: Tables) -> DataFrame:
    return _fields(t).select("page_id", F.explode("meta").alias("name", "content"))


@query("TX3", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T' ELSE 'n' END || page_id AS title FROM {pages}")
def tx3(t: Tables) -> DataFrame:
    return I.page_fields(_fields(t)).select("page_id", "title")


@query("TX4", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'D' || (page_id % 5) END AS description FROM {pages}")
def tx4(t: Tables) -> DataFrame:
    return I.page_fields(_fields(t)).select("page_id", "description")


@query("TX5", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'u' || page_id END AS canonical FROM {pages}")
def tx5(t: Tables) -> DataFrame:
    return _fields(t).select("page_id", F.coalesce(F.col("meta")["og:url"], F.col("meta")["url"]).alias("canonical"))


@query("TX6", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\\[.*?\\]', '', 'g'), ' ' || chr(9))), ' ') AS body FROM {documents}")
def tx6(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.paragraph_text(F.split("text", "\n")).alias("body"))


@query("TX7", "SELECT doc_id, array_to_string(regexp_extract_all(text, '\\S+')[1:500], ' ') AS summary FROM {documents}")
def tx7(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("TX8", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM {documents}")
def tx8(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("words"))


@query("TX9", "SELECT url, count(*) AS terms FROM {tokens} GROUP BY url")
def tx9(t: Tables) -> DataFrame:
    return t.english.select("url", F.size(T.index_terms(T.words(F.col("text")))).cast("bigint").alias("terms")).where("terms > 0")


_VOTES = {k: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v)})))" for k, v in T.COMMON_WORDS.items()}


@query("TX10", "SELECT doc_id, CASE WHEN greatest(" + ", ".join(_VOTES) + ") = 0 THEN NULL " + " ".join(f"WHEN {k} = greatest({', '.join(_VOTES)}) THEN '{k}'" for k in _VOTES) + " END AS lang FROM (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _VOTES.items())
       + " FROM (SELECT doc_id, regexp_extract_all(lower(left(array_to_string(regexp_extract_all(text, '\\S+')[1:500], ' '), 1000)), '\\pL+') AS w FROM {documents}))")
def tx10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.detected_language(T.summary(F.col("text"))).alias("lang"))


@query("TX10_page", "SELECT page_id, regexp_extract(html, '<html[^>]*lang=\"([a-z]+)\"', 1) AS lang FROM {pages}")
def tx10_page(t: Tables) -> DataFrame:
    # what the page declares
    return t.pages.select("page_id", F.regexp_extract("html", '<html[^>]*lang="([a-z]+)"', 1).alias("lang"))


@query("TX11", "SELECT image_url, array_to_string(list_filter(list_transform(regexp_split_to_array(filename, '[-_./\\s]+'), lambda x: lower(x)), lambda x: x <> '' AND x NOT IN ('png', 'svg', 'ico', 'gif', 'jpeg', 'jpg') AND NOT contains(x, 'px')), ' ') AS parts FROM {images}")
def tx11(t: Tables) -> DataFrame:
    return t.images.select("image_url", F.array_join(T.split_name(F.col("filename")), " ").alias("parts"))


_URL_PARTS = f"list_filter(list_transform(regexp_split_to_array(url, '[.,\\-_/+:()]'), lambda x: lower(x)), lambda x: x <> '' AND x NOT IN ({', '.join(repr(x) for x in T.POPULAR_DOMAINS)}))"


@query("TX12", f"SELECT page_id, array_to_string({_URL_PARTS}, ' ') AS parts FROM {{pages}}")
def tx12(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(T.split_url(F.col("url")), " ").alias("parts"))


@query("TX13", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 9)::DOUBLE WHEN event_id % 9 > 0 THEN (event_id % 9) * pow(50.0, event_id % 4) ELSE 10 * pow(50.0, event_id % 4 - 1) END AS weight FROM {events}")
def tx13(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.boosted(F.col("event_id") % 9, F.col("event_id") % 4).alias("weight"))


@query("TX14", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM {documents}")
def tx14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("flat"))


@query("TX15", "SELECT image_url, string_split(image_url, '/')[-1] AS filename, regexp_extract(string_split(image_url, '/')[-1], '\\.([^.]*)$', 1) AS extension FROM {images}")
def tx15(t: Tables) -> DataFrame:
    name = T.filename(F.col("image_url"))
    return t.images.select("image_url", name.alias("filename"), T.extension(name).alias("extension"))


@query("TX17", "SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(replace(q, '+', ' ')), ' '), lambda x: x <> ''))), ' ') AS terms FROM {searches}")
def tx17(t: Tables) -> DataFrame:
    return t.searches.select("event_id", F.array_join(F.array_sort(T.query_terms(F.col("q"))), " ").alias("terms"))


@query("TX18", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS snippet FROM {documents}")
def tx18(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("TX19", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short, CASE WHEN length(text) > 600 THEN left(text, 600) || '...' ELSE text END AS long FROM {documents}")
def tx19(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.snippet(F.col("text"), 200).alias("short"), T.snippet(F.col("text"), 600).alias("long"))


@query("TX20", "SELECT post_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {posts}")
def tx20(t: Tables) -> DataFrame:
    return t.posts.select("post_id", T.slug(F.col("title"), "post").alias("slug"))


_TENTHS = "regexp_replace((floor(n / {0}) / 10)::DECIMAL(20,1)::VARCHAR, '\\.0$', '')"


@query("TX21", f"SELECT event_id, CASE WHEN n >= 1000000000 THEN {_TENTHS.format(100000000)} || 'B' WHEN n >= 1000000 THEN {_TENTHS.format(100000)} || 'M' WHEN n >= 1000 THEN {_TENTHS.format(100)} || 'K' ELSE n::VARCHAR END AS shown FROM (SELECT event_id, event_id * event_id * 7 AS n FROM {{events}})")
def tx21(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.compact_count(F.col("event_id") * F.col("event_id") * 7).alias("shown"))


# each search as it was typed, with a letter too many in every other one
_TYPED = "(SELECT event_id AS id, concat(q, CASE WHEN event_id % 2 = 0 THEN ' thee+andd' ELSE ' of' END) AS q FROM {searches})"


@query("TX22", f"""WITH t AS MATERIALIZED (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT id, list_filter(string_split(lower(replace(q, '+', ' ')), ' '), lambda x: x <> '') AS w FROM {_TYPED})),
    u AS MATERIALIZED (SELECT DISTINCT term, term AS word FROM t), c AS (SELECT term, word FROM {SPELL.replace('{misspelled}', 'u')} QUALIFY row_number() OVER (PARTITION BY term ORDER BY distance, word) = 1)
    SELECT id, CASE WHEN bool_or(coalesce(c.word, t.term) <> t.term) THEN string_agg(coalesce(c.word, t.term), ' ' ORDER BY pos) END AS shown FROM t LEFT JOIN c USING (term) GROUP BY id""")
def tx22(t: Tables) -> DataFrame:
    found = S.corrected_queries(t.asked(_TYPED), t.dictionary)
    return found.select("id", S.did_you_mean(F.col("query"), F.col("changed")).alias("shown"))


@query("TX23", "SELECT page_id, len(regexp_extract_all(html, 'https?://[^\\s<>()\\[\\]{}\"'']+')) AS urls FROM {pages}")
def tx23(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(T.urls_in(F.col("html"))).cast("bigint").alias("urls"))


@query("TX24", "SELECT doc_id, sha256(text) AS digest FROM {documents}")
def tx24(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("TX25", "SELECT page_id, url_encode(url) AS path FROM {pages}")
def tx25(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.percent_decoded(F.url_encode("url")).alias("path"))


_PAYLOAD = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN concat('[\"', event_type, '\"]') WHEN 2 THEN concat('[\"a,b\", \"', event_type, '\", \"\"]') WHEN 3 THEN 'no list' END AS json FROM {events})"


@query("TX26", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 END::BIGINT AS items, CASE event_id % 5 WHEN 1 THEN event_type WHEN 2 THEN 'a,b|' || event_type || '|' WHEN 0 THEN '' END AS joined FROM {events}")
def tx26(t: Tables) -> DataFrame:
    found = T.string_list(F.col("json"))
    return t.asked(_PAYLOAD).select("event_id", F.when(found.isNotNull(), F.size(found)).cast("bigint").alias("items"), F.array_join(found, "|").alias("joined"))


@query("TX27", "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE event_id::VARCHAR END AS BIGINT) AS n FROM {events}")
def tx27(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr("try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE cast(event_id as string) END AS BIGINT)").alias("n"))


@query("TX27_time", "SELECT event_id, date_trunc('second', ts) AS seen FROM {events}")
def tx27_time(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return t.events.select("event_id", T.rfc1123(text).cast("timestamp_ntz").alias("seen"))


@query("TX28", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM {events}")
def tx28(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.iso_time(F.date_trunc("second", "ts")).alias("iso"))
