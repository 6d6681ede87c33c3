"""Jobs on small tables, with the values that the data model's own rules pin."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from hearthline.functions import extract
from hearthline.operators import cards, dedup, documents, filters, frontier, history, index, listings, maintenance, requests, resolve, search
from hearthline.sources import io


def test_value_averages(spark):
    rows = spark.createDataFrame([("a", 400000.0, 80.0, 0), ("b", 600000.0, 0.0, 1), ("b", 900000.0, 90.0, 2), ("c", None, 50.0, 3)], "id string, price double, usable_area double, seq int")
    assert tuple(search.value_averages(rows.withColumn("price", F.col("price").cast("decimal(14,2)")), order="seq").first()) == (500000.0, 2, 5000.0, 1)


def test_page_clamps(spark):
    rows = spark.range(300).selectExpr("id", "timestamp'2024-01-01' as updated_at")
    assert search.page(rows, 100000).count() == 100 and search.page(rows, 0).count() == 1 and search.page(rows, None, -3).count() == 20
    assert search.page(rows, 5, 2).first().id == 297


def _collector(spark, **over):
    base = dict(id=42, status="ACTIVE", sale_price=750000.5, rental_price=None, city="Belo Horizonte", state="MG", neighborhood="Savassi", property_type="APARTMENT", bedrooms=3, usable_area=92.5, title=None, url="u", source="zap", bathrooms=2, parking_spaces=1)
    row = base | over
    return spark.createDataFrame([tuple(row.values())], "id long, status string, sale_price double, rental_price double, city string, state string, neighborhood string, property_type string, bedrooms int, usable_area double, title string, url string, source string, bathrooms int, parking_spaces int")


def test_catalogue_and_cards(spark):
    row = _collector(spark)
    assert filters.catalogue(row, city="belo horizonte", max_price=800000).count() == 1
    assert filters.catalogue(row, "RENT").count() == 0
    none = _collector(spark, sale_price=None)
    assert filters.catalogue(none).count() == 1 and filters.catalogue(none, min_price=1).count() == 0
    card = cards.collector_cards(row).first()
    assert card.id == "collector-42" and card.title == "Apartamento em Savassi" and card.price == 750000.5


def test_criteria(spark):
    rows = spark.createDataFrame([("bh", "MG", None, 5.0, 1.0), (" ", "MG", None, None, None), ("bh", "m", "sale", 1.0, 2.0), ("bh", "MG", "swap", None, None), ("bh", "MG", "rent", None, None)], "city string, state string, transaction string, min_price double, max_price double")
    rows = rows.selectExpr("*", "'' as neighborhood", "cast(null as string) as property_type", "cast(null as double) as min_area", "cast(null as double) as max_area", "cast(null as int) as bedrooms")
    assert [r.error for r in filters.validate_criteria(rows).collect()] == ["minimum price above maximum", "city is missing", "state must have 2 to 40 characters", "unknown transaction", None]


def test_robots(spark):
    content = "User-agent: *\nDisallow: /privado/\nAllow: /privado/publico/ # ok\n\nUser-agent: other\nUser-agent: bot2\nDisallow: /\n"
    files = spark.createDataFrame([("h", content)], "host string, content string")
    pages = spark.createDataFrame([("h", "/privado/item"), ("h", "/privado/publico/item"), ("h", "/x"), ("i", "/privado/item")], "host string, path string")
    allowed = lambda agent: {(r.host, r.path): r.allowed for r in filters.robots_allowed(pages, extract.robots_rules(files), agent).collect()}
    got = allowed("listingbot/1.0")
    assert got == {("h", "/privado/item"): False, ("h", "/privado/publico/item"): True, ("h", "/x"): True, ("i", "/privado/item"): True}
    assert allowed("Bot2 (+x)")["h", "/x"] is False


def test_normalized_listing(spark):
    item = {"sku": "ABC-10", "name": "Apto", "url": "/imovel/1", "offers": {"price": "750000"}, "numberOfRooms": "3", "floorSize": {"value": "82 m²"}, "image": ["/a.jpg", "/a.jpg"], "address": {"streetAddress": "Rua A"}, "amenities": "pool, gym;pool"}
    rows = [(1, "https://h/list", 0, json.dumps(item)), (1, "https://h/list", 1, '{"name": "x"}'), (1, "https://h/list", 2, '{"url": "/2", "name": "x"}')]
    items = spark.createDataFrame(rows, "page_id long, url string, seq long, item string")
    got = {r.seq: r for r in listings.normalize_listings(items, "SRC", "SALE", "APARTMENT", "BH", "mg", ("Savassi",)).collect()}
    r = got[0]
    assert (r.external_id, r.bedrooms, r.area_m2, r.price, r.url) == ("ABC-10", 3, 82.0, 750000.0, "https://h/imovel/1")
    assert (r.image_urls, r.amenities, r.normalized_address, r.state) == (["https://h/a.jpg"], ["POOL", "GYM"], "rua a, savassi, bh", "MG")
    assert [got[k].reject for k in (0, 1, 2)] == [None, "no address", "no price"]


def test_portal_rows(spark):
    item = {"@type": "Apartment", "url": "https://x/imovel/apartamento-2-quartos-castelo-belo-horizonte-com-garagem-70m2-venda-RS650000-id-123456/", "name": "Apto &amp; sol", "description": "com 2 banheiros e 1 vaga", "address": {"streetAddress": "Rua Lauro Ferreira, Castelo", "addressLocality": "Belo Horizonte"}}
    rent = {"@type": "House", "url": "https://x/aluguel/casa-1/", "sku": "9", "offers": [{"price": "2500"}]}
    items = spark.createDataFrame([(1, "p", i, json.dumps(x)) for i, x in enumerate([item, rent])], "page_id long, url string, seq long, item string")
    r = listings.portal_rows(items, "VIVAREAL", {"city": "Belo Horizonte", "transaction": "SALE"}).collect()
    assert [(x.source_id, x.sale_price, x.neighborhood, x.bathrooms, x.parking_spaces, x.street, x.title) for x in r] == [("123456", 650000.0, "Castelo", 2, 1, "Rua Lauro Ferreira", "Apto & sol")]
    r = listings.portal_rows(items, "ZAP", {"transaction": "RENT"}).collect()
    assert [(x.source_id, x.rental_price, x.sale_price, x.property_type) for x in r] == [("9", 2500.0, None, "HOUSE")]
    good, bad = listings.check_contract(listings.portal_rows(items, "ZAP"), "OTHER")
    assert good.count() == 0 and bad.first().reject_reasons == ["foreign source"]
    registry = listings.Connectors(["VIVAREAL"])
    registry.register("VIVAREAL", lambda df: listings.portal_rows(df, "VIVAREAL"))
    registry.register("ZAP", lambda df: listings.portal_rows(df, "ZAP"))
    assert registry.codes() == ["VIVAREAL"] and registry.collect({"VIVAREAL": items, "ZAP": items}).count() == 1
    with pytest.raises(ValueError, match="lack"):
        listings.check_contract(items, "ZAP")


def test_gateway_and_offers(spark):
    payload = json.dumps({"id": "7", "title": "x", "address": "Rua Curitiba, 10", "transaction_type": "RENT", "price": "3500", "bedrooms": 2.7})
    r = listings.gateway_listings(spark.createDataFrame([(payload,)], "payload string"), "G").first()
    assert (r.normalized_address, r.transaction_type, r.price, r.bedrooms, r.area_m2) == ("rua curitiba, 10", "RENT", 3500.0, 2, None)
    # only RENT as it stands is a rental; prices aren't negative, other numbers are as given
    other = json.dumps({"id": "8", "transaction_type": "rent", "price": -5, "bathrooms": -1, "bedrooms": "x"})
    r = listings.gateway_listings(spark.createDataFrame([(other,)], "payload string"), "G").first()
    assert (r.transaction_type, r.price, r.bathrooms, r.bedrooms, r.property_type) == ("SALE", 0.0, -1, None, "APARTMENT")
    item = json.dumps({"@type": "RealEstateListing", "offers": {"itemListElement": [{"item": {"url": "https://x/imovel/1"}}, {"url": "https://x/other"}]}})
    items = spark.createDataFrame([(1, "p", 0, item)], "page_id long, url string, seq long, item string")
    assert [r.url for r in listings.offer_items(items).collect()] == ["https://x/imovel/1"]


def test_upsert(spark):
    columns = "source string, source_id string, title string, price double, status string, first_seen_at timestamp, created_at timestamp, last_seen_at timestamp, updated_at timestamp"
    old = spark.sql("select 'a' source, '1' source_id, 'old' title, 5D price, 'INACTIVE' status, timestamp'2020-01-01' first_seen_at, timestamp'2020-01-01' created_at, timestamp'2020-01-01' last_seen_at, timestamp'2020-01-01' updated_at")
    assert len(columns.split(",")) == len(old.columns)
    batch = spark.createDataFrame([("a", "1", "mid", 7.0, 0), ("a", "1", None, 8.0, 1), ("b", "2", "new", 1.0, 2)], "source string, source_id string, title string, price double, seq int")
    got = {r.source: r for r in io.upsert(old, batch, "2024-01-01").collect()}
    assert (got["a"].title, got["a"].price, got["a"].status, got["a"].first_seen_at.year, got["a"].last_seen_at.year) == (None, 8.0, "ACTIVE", 2020, 2024)
    assert got["b"].created_at.year == 2024


def test_absences(spark):
    presence = spark.sql("select 1L listing_id, 's' scope_id, 0 misses, 'ACTIVE' status, timestamp'2024-01-01' last_seen_at, cast(null as timestamp) inactive_at")
    none = spark.createDataFrame([], "listing_id long, scope_id string")
    run = lambda status, kind: spark.createDataFrame([("s", status, kind)], "scope_id string, status string, run_type string")
    after = history.apply_absences(presence, none, run("COMPLETED", "FULL"), "2024-01-02", misses=1, hours=0)
    assert [(r.status, r.misses, r.absent) for r in after.collect()] == [("INACTIVE", 1, True)]
    assert history.global_inactivations(after).first().reason == "MISSING_FROM_HEALTHY_FULL_RUNS"
    assert history.apply_absences(presence, none, run("PARTIAL", "FULL"), "2024-01-02", 1, 0).first().status == "ACTIVE"
    assert history.apply_absences(presence, none, run("COMPLETED", "FULL"), "2024-01-02", 3, 0).first().status == "STALE"


def test_run_outcomes(spark):
    rows = spark.createDataFrame([(1, "a", True, None, None, 1), (1, "b", False, "late", 5, 1), (2, "a", False, "x", 9, 1), (2, "b", False, "y", 20, 1), (3, "a", False, "z", 1, 3)], "search_id long, source string, ok boolean, error string, retry_after int, attempt int")
    got = {r.search_id: tuple(r)[1:] for r in requests.run_outcomes(rows).collect()}
    assert got == {1: ("COMPLETED", "b: late", None), 2: ("RETRYING", "y", 20), 3: ("FAILED", "z", 1)}


def _ad(seq, source, **over):
    base = dict(seq=seq, source=source, city="BH", state="MG", property_type="APARTMENT", street="Rua A, 10", description=None, neighborhood="Savassi", sale_price=1.0, rental_price=None, usable_area=85.0, bedrooms=3, bathrooms=2, parking_spaces=1, suites=None)
    return tuple((base | over).values())


_AD = "seq long, source string, city string, state string, property_type string, street string, description string, neighborhood string, sale_price double, rental_price double, usable_area double, bedrooms int, bathrooms int, parking_spaces int, suites int"


def test_cross_source(spark):
    ads = spark.createDataFrame([_ad(1, "a"), _ad(2, "b", street="R. A 10", usable_area=87.0), _ad(3, "a"), _ad(4, "c", street="Rua B"), _ad(5, "d", sale_price=None, rental_price=5.0)], _AD)
    got = {(r.a, r.b): r.score for r in dedup.similar_ads(ads).collect()}
    assert got == {(1, 2): 100, (2, 3): 100}
    assert {r.seq: r.representative for r in dedup.representatives(ads).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_cross_source_is_exact(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [r.sample(vocabulary, 30) for _ in range(12)]
    ads = []
    for i in range(160):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        ads.append(_ad(i, r.choice("abc"), street=r.choice([None, None, "Rua A", "av b"]), description=" ".join(words[: r.choice([5, 12, 30])]), city=r.choice(["BH", "bh"]), usable_area=r.choice([None, 80.0, 90.0]), suites=1))
    df = spark.createDataFrame(ads, _AD)
    from hearthline.functions.scoring import ad_similarity, prepared_ads

    ready = prepared_ads(df)
    x, y = ready.alias("x"), ready.alias("y")
    all_pairs = x.join(y, F.col("x.seq") < F.col("y.seq")).select("x.seq", F.col("y.seq").alias("b"), ad_similarity("x", "y").alias("s"))
    score = {(a, b): s for a, b, s in all_pairs.where("s > 0").collect()}
    assert {(a, b): s for a, b, s in dedup.similar_ads(df).collect()} == score
    leaders, want = [], {}
    for i in range(160):
        want[i] = next((k for k in leaders if score.get((k, i), 0) >= 90), i)
        if want[i] == i:
            leaders.append(i)
    assert {r.seq: r.representative for r in dedup.representatives(df).collect()} == want


def test_best_match_is_exact(spark):
    r = random.Random(6)
    row = lambda i: (i, r.choice(["A", "a", "B"]), r.choice(["x", "X", None]), r.choice([None, "rua a, 1", "1 a rua", "rua b"]), r.choice([None, 50.0, 52.0, 60.0]), r.choice([None, 1, 2]), r.choice([1, 2]))
    schema = "{} long, city string, neighborhood string, normalized_address string, area_m2 double, bedrooms int, parking_spaces int"
    props, inc = spark.createDataFrame([row(i) for i in range(80)], schema.format("property_id")), spark.createDataFrame([row(i) for i in range(60)], schema.format("incoming_id"))
    from hearthline.functions.scoring import listing_similarity

    a, b = inc.alias("a"), props.alias("b")
    pairs = a.join(b, (F.lower("a.city") == F.lower("b.city")) & (F.lower("a.neighborhood") == F.lower("b.neighborhood"))).select("incoming_id", "property_id", listing_similarity("b", "a").alias("s")).collect()
    got = {x.incoming_id: (x.property_id, x.score) for x in resolve.best_matches(inc, props).collect()}
    for i in range(60):
        best = max(((s, -p) for k, p, s in pairs if k == i and s >= 75), default=None)
        assert got[i] == ((-best[1], best[0]) if best else (None, None))


def test_merges_and_repairs(spark):
    m = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (9, 8), (20, 21), (21, 20)], "property_id long, candidate_id long")
    got = {r.property_id: r.target for r in maintenance.resolve_merges(m.where("property_id < 20")).collect()}
    assert got == {4: 1, 3: 1, 2: 1, 9: 8}
    rows = spark.createDataFrame([("x-aluguel-y", 5.0, None), ("x-venda-y", None, 5.0), ("x-aluguel-venda-y", 5.0, None), ("x", 1.0, 2.0)], "url string, sale_price double, rental_price double")
    assert [tuple(r)[1:] for r in maintenance.repair_transaction(rows.withColumn("url", F.col("url"))).select("url", "sale_price", "rental_price").collect()] == [(None, 5.0), (5.0, None), (5.0, None), (1.0, 2.0)]


def test_documents(spark):
    docs = [
        {"_id": "1", "titulo": "Apto", "cidade": "BH", "uf": "MG", "preco_venda": "R$ 250.000,00", "ativo": True, "link": "https://a/imovel/1", "fotos": [{"url": "f1"}, "f2"], "quartos": 2},
        {"id": "2", "cidade": "BH", "uf": "MG", "status": "inactive", "url": "https://a/imovel/2"}, {"id": "3", "status": "vendido", "ativo": True, "url": "u"}, {"titulo": "no id", "ativo": True, "url": "u"}, {"id": "5", "ativo": "false", "url": "u", "status": "ativo"},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    d = F.col("doc")
    assert [r[0] for r in df.select(documents.available(d)).collect()] == [True, True, False, True, False]
    assert [r[0] for r in df.select(documents.available(d, strict=True)).collect()] == [True, False, False, True, False]
    c = documents.candidates(df).orderBy("id").first()
    assert (c.id, c.title, c.price, c.image_url, c.href, c.bedrooms) == ("1", "Apto", 250000.0, "f1", "https://a/imovel/1", 2.0)
    assert documents.candidates(df).count() == 4
    s = spark.sql("select 7L search_id, 'BH' city, 'MG' state, cast(null as string) neighborhood, 'SALE' transaction, cast(null as string) property_type, 2 bedrooms, cast(null as double) min_area, cast(null as double) max_area, cast(null as double) min_price, 300000D max_price")
    got = documents.search(df, s).collect()
    assert [x.id for x in got] == ["1", "2"] and got[0].score > got[1].score
    assert documents.prefilter(df, "other", "bh", "MG").count() == 1
    assert documents.collector_rows(df).where("source_id = '1'").first().sale_price == 250000.0


def test_index(spark):
    row = spark.sql("select 'VIVAREAL' source_code, '2763318568' external_id, 'SALE' transaction_type, 'APARTMENT' property_type, 'Savassi' neighborhood, 'BH' city, 'MG' state, 5D price, array(' pool ', 'Balcony', 'POOL') amenities, 'https://x/1' url, timestamp'2024-01-01' updated_at")
    doc = index.index_documents(row)
    r = doc.first()
    assert (r.id, r.amenities, r.title, r.sale_price, r.rental_price) == ("vivareal-2763318568", ["BALCONY", "POOL"], "Apartamento em Savassi, BH", 5.0, None)
    assert index.violations(doc).first().violations == []
    bad = doc.withColumns({"id": F.lit("vivareal-other"), "state": F.lit("Minas"), "transaction_types": F.array(F.lit("RENT"))})
    assert index.violations(bad).first().violations == ["state", "id_mismatch", "transactions_and_prices"]
    assert json.loads(index.to_index_json(doc).toJSON().first())["structData"]["city"] == "BH"


def test_municipalities(spark):
    known = spark.createDataFrame([("MG", "São José da Lapa"), ("MG", "Esmeraldas"), ("SP", "São José dos Campos"), ("MG", "Nova São José")], "state string, name string")
    asked = spark.createDataFrame([("ESMERALDAS", "mg"), ("sao jose da lapa", "MG"), ("esmeraldas", "XX")], "city string, state string")
    got = {(r.city, r.state): r.municipality for r in frontier.municipality_match(asked, known).collect()}
    assert got == {("ESMERALDAS", "mg"): "Esmeraldas", ("sao jose da lapa", "MG"): "São José da Lapa", ("esmeraldas", "XX"): None}
    q = spark.createDataFrame([("sao jose",), ("x",)], "query string")
    assert [r.name for r in frontier.autocomplete(known.where("state = 'MG'"), q).orderBy("rn").collect()] == ["São José da Lapa", "Nova São José"]


def test_search_addresses(spark):
    r = spark.sql("select 'São Paulo' city, 'SP' state, 'Vila Nova' neighborhood, 'RENT' transaction, 'HOUSE' property_type, 1000D min_price, cast(null as double) max_price, cast(null as double) min_area, cast(null as double) max_area, 2 bedrooms")
    got = {x.portal: x.url for x in frontier.frontier(r).collect()}
    assert got["VIVAREAL"] == "https://www.vivareal.com.br/aluguel/sp/sao-paulo/bairros/vila-nova/casa_residencial/?precoMinimo=1000&quartos=2"
    assert got["ZAP"] == "https://www.zapimoveis.com.br/aluguel/casas/sp%2Bsao-paulo%2Bvila-nova/?precoMinimo=1000"
    assert got["QUINTOANDAR"] == "https://www.quintoandar.com.br/alugar/imovel/vila-nova-sao-paulo-sp-brasil/casa"
    assert got["CHAVESNAMAO"] == "https://www.chavesnamao.com.br/casas-para-alugar/sp-sao-paulo/"


def test_richest_and_unique(spark):
    rows = spark.createDataFrame([("1", "t", None, 1, 0), ("2", "t", "d", 1, 1), ("1", "t", "d", 2, 2), ("1", "u", "d", 2, 3)], "source_id string, title string, description string, bedrooms int, seq int")
    got = {r.source_id: (r.position, r.seq) for r in dedup.richest_records(rows, ["source_id"]).collect()}
    assert got == {"1": (0, 2), "2": (1, 1)}
    items = spark.createDataFrame([(1, 0, '{"url":"a"}'), (1, 1, '{"url":"a","x":1}'), (1, 2, '{"@id":"b"}'), (1, 3, '{"z":1}'), (1, 4, '{"z":1}'), (2, 0, '{"url":"a"}')], "page_id int, seq int, item string")
    assert sorted((r.page_id, r.seq) for r in dedup.unique_items(items).collect()) == [(1, 0), (1, 2), (1, 3), (2, 0)]
