"""Text, number, URL and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, numbers, text, urls
from ..operators import filters
from .registry import query
from .views import table

_FOLD = "regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g')"


@query(f"SELECT doc_id, md5(array_to_string(regexp_extract_all({_FOLD}, '[a-z0-9]+'), ' ')) AS folded FROM documents WHERE text IS NOT NULL")
def fold_tokens(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(text.fold_tokens(F.col("text"))).alias("folded"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def slugs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.slugify(F.col("c_name")).alias("slug"))


_STREET = "CASE c_custkey % 4 WHEN 0 THEN 'R. ' WHEN 1 THEN 'Av ' WHEN 2 THEN 'pça. ' ELSE 'Rua ' END || c_name"


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'rua ' WHEN 1 THEN 'avenida ' WHEN 2 THEN 'praca ' ELSE 'rua ' END || array_to_string(regexp_extract_all(lower(c_name), '[a-z0-9]+'), ' ') AS street FROM customer")
def street_normalize(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.normalized_street(F.expr(_STREET)).alias("street"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 0.0 ELSE CAST(floor(o_totalprice) AS DOUBLE) + CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0 END END AS price FROM orders""")
def money_parse(spark, sf):
    whole = F.floor("o_totalprice").cast("bigint")
    dotted = F.regexp_replace(F.format_number(whole, 0), ",", ".")
    kind = F.col("o_orderkey") % 4
    written = F.when(kind == 0, F.concat(F.lit("R$ "), dotted, F.lit(",50"))).when(kind == 1, F.concat(F.lit("R$ "), whole.cast("string"))).when(kind == 2, "sob consulta")
    return table(spark, sf, "orders").select("o_orderkey", numbers.money(written).alias("price"))


_PATH = "'https://x.com/imovel/' || CASE c_custkey % 5 WHEN 0 THEN 'apartamento' WHEN 1 THEN 'casa' WHEN 2 THEN 'cobertura' WHEN 3 THEN 'sala-comercial' ELSE 'lote' END || '-' || CAST(c_custkey % 4 + 1 AS STRING) || '-quartos-vila-nova-belo-horizonte-com-garagem-' || CAST(c_custkey % 90 + 30 AS STRING) || 'm2-' || CASE WHEN c_custkey % 2 = 0 THEN 'venda' ELSE 'aluguel' END || '-RS' || CAST(c_custkey * 100 AS STRING) || '-id-' || CAST(c_custkey AS STRING) || '/'"  # noqa: E501


@query("""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS listing_id, CAST(c_custkey * 100 AS BIGINT) AS price, CAST(c_custkey % 90 + 30 AS INT) AS area, CAST(c_custkey % 4 + 1 AS INT) AS bedrooms, CAST(0 AS INT) AS parking_spaces,
  CASE c_custkey % 5 WHEN 0 THEN 'APARTMENT' WHEN 1 THEN 'HOUSE' WHEN 2 THEN 'PENTHOUSE' WHEN 3 THEN 'COMMERCIAL_ROOM' ELSE 'OTHER' END AS property_type, CASE WHEN c_custkey % 2 = 0 THEN 'SALE' ELSE 'RENT' END AS transaction,
  CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'Vila Nova' END AS neighborhood FROM customer""")
def url_facts(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_PATH).alias("url"))
    return rows.select("c_custkey", urls.facts(F.col("url"), F.lit("Belo Horizonte")).alias("f")).select("c_custkey", "f.*")


@query("""SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://') AND lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) IN (SELECT host FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages) t WHERE host LIKE '%.example.net')""")
def allowed_hosts(spark, sf):
    pages = table(spark, sf, "pages")
    hosts = pages.select(urls.host(F.col("url")).alias("host")).where("host like '%.example.net'").distinct()
    return filters.allowed_hosts(pages, hosts).select("page_id", "url")


_PAGE_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_PAGE_PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"
#: Robots texts that differ by the length of the host's name: its own rules beside those of all, rules of all alone, or none for this agent.
_RULES = [
    "User-agent: *\nDisallow: /en/\nAllow: /en/1\n\nUser-agent: otherbot\nDisallow: /\n",
    "User-agent: *\nDisallow: /\n\nUser-agent: ListingBot\nDisallow: /de/ # german\nDisallow: /fr\nAllow: /fr\n",
    "User-agent: otherbot\nDisallow: /\n",
]


@query(f"""WITH p AS (SELECT page_id, length({_PAGE_HOST}) % 3 AS k, {_PAGE_PATH} AS path FROM pages)
SELECT page_id, CASE WHEN k = 0 THEN starts_with(path, '/en/1') OR NOT starts_with(path, '/en/') WHEN k = 1 THEN NOT starts_with(path, '/de/') ELSE TRUE END AS allowed FROM p""")
def robots_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    kind = F.length("host") % 3
    content = F.when(kind == 0, _RULES[0]).when(kind == 1, _RULES[1]).otherwise(_RULES[2])
    files = pages.select("host").distinct().withColumn("content", content)
    return filters.robots_allowed(pages, extract.robots_rules(files), "listingbot/1.0 (+https://x)").select("page_id", "allowed")


@query()
def html_cards(spark, sf):
    selectors = {"card": "article", "title": "h1", "description": "p", "url": {"selector": "a[href]", "attribute": "href"}}
    return extract.page_items(table(spark, sf, "pages"), "HTML", selectors)


@query("""SELECT page_id, i - 1 AS seq, titles[i] AS title, regexp_extract(url, '^(https?://[^/?#]+)', 1) || hrefs[i] AS url FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS titles FROM pages) t, UNNEST(range(1, len(hrefs) + 1)) AS u(i)""")
def link_cards(spark, sf):
    """A card for each entry of the pages' lists, by selectors: a field's text and another's attribute."""
    rows = extract.page_items(table(spark, sf, "pages"), "HTML", {"card": "li", "title": "a", "url": {"selector": "a[href]", "attribute": "href"}})
    return rows.select("page_id", "seq", F.get_json_object("item", "$.title").alias("title"), F.get_json_object("item", "$.url").alias("url"))


@query("SELECT page_id, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) <> '' AS has_title FROM pages")
def page_titles(spark, sf):
    rows = extract.page_items(table(spark, sf, "pages"), "HTML", {"card": "h1", "title": ":scope"}).groupBy("page_id").agg(F.bool_or(F.get_json_object("item", "$.title").isNotNull()).alias("t"))
    return table(spark, sf, "pages").select("page_id").join(rows, "page_id", "left").select("page_id", F.coalesce("t", F.lit(False)).alias("has_title"))


_PLAIN = "text"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char}')"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM (SELECT doc_id, nullif(text, '') AS text FROM documents) t")
def clean_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))
