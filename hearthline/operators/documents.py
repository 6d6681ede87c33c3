"""Loose documents (JSON with field names in two languages, flat or nested) as a source of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, scoring
from ..functions.text import fold_upper, slugify, strip_marks
from .listings import title_of
from .search import compatibility_top, top_n

# Field names of documents.
ID = ("_id", "id", "property_id", "source_id")
IMAGES = ("image_urls", "images", "photos", "fotos")
TITLE = ("title", "titulo", "name", "nome")
IMAGE = ("image_url", "imagem", "coverImage", "mainImage")
HOOD = ("neighborhood", "bairro", "address.neighborhood", "location.neighborhood")
CITY = ("city", "cidade", "address.city", "location.city")
STATE = ("state", "uf", "estado", "address.state", "location.state")
PRICE = ("price", "preco", "preco_venda", "preco_avaliacao", "sale_price", "salePrice", "valor", "rental_price", "rentalPrice")
AREA = ("usable_area", "usableArea", "area_m2", "area", "areaUtil", "area_util", "area_construida", "area_privativa", "area_total")
BEDS = ("bedrooms", "quartos", "dorms", "dormitorios")
BATHS = ("bathrooms", "banheiros")
PARKING = ("parking_spaces", "parkingSpaces", "vagas", "garages")
TYPE = ("property_type", "propertyType", "tipo_imovel", "tipo", "type")
TRANSACTION = ("transaction", "transaction_type", "transactionType", "negocio", "modo_venda")
DESCRIPTION = ("description", "descricao", "caracteristicas")
ADDRESS = ("address", "endereco", "street", "logradouro")
AMENITIES = ("amenities", "caracteristicas", "features")
ACTIVE = ("ativo", "active", "disponivel", "available")
STATUS = ("status", "situacao", "availability", "disponibilidade")
DIRECT = ("url", "link", "sourceUrl", "href")
AUCTION = ("site_leiloeiro", "url_leiloeiro", "link_leiloeiro")
CODES = ("hdn_imovel", "codigo", "code", "source_id")


def field(doc: Column, name: str) -> Column:
    """A field of a document as text, objects and arrays as JSON; null if there is none, or no document. The document is read as a VARIANT, which Spark does once for all fields of an expression list."""
    return F.try_variant_get(F.try_parse_json(doc), "$." + name, "string")


def first_value(doc: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that is neither null nor empty, as text."""
    values = [field(doc, n) for n in names]
    return F.coalesce(*[F.when(v != "", v) for v in values])


def text(doc: Column, names: tuple[str, ...]) -> Column:
    value = F.trim(first_value(doc, names))
    return F.when(value != "", value)


def number(doc: Column, names: tuple[str, ...]) -> Column:
    raw = first_value(doc, names)
    plain = raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    # what could be a JSON number is itself, but for thousands parted by dots
    return F.when(plain & ~raw.rlike(r"^\d{1,3}(\.\d{3})+$"), raw.try_cast("double")).otherwise(numbers.document_number(raw))


def strings(doc: Column, names: tuple[str, ...]) -> Column:
    """An array's texts, and its objects' url, src or href."""
    items = F.from_json(first_value(doc, names), "array<string>")
    opened = F.transform(items, lambda v: F.when(F.startswith(v, F.lit("{")), text(v, ("url", "src", "href"))).otherwise(v))
    return F.coalesce(F.filter(opened, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))


def available(doc: Column, strict: bool = False) -> Column:
    """Not marked off, no word of being gone in status or description, and marked or called available. Words hold parts of words ("inactive" holds "active"); strict looks at whole words."""
    flag = first_value(doc, ACTIVE)
    words = F.concat_ws(" ", text(doc, STATUS), text(doc, ("descricao", "description")))
    off = F.coalesce(F.trim(flag).rlike("(?i)^(false|0|nao|não|inativo|inactive)$"), F.lit(False))
    gone = words.rlike("(?i)indisponivel|indisponível|vendido|encerrado|cancelado|desativado|inativo")
    edge = r"\b" if strict else ""
    on = words.rlike(f"(?i){edge}(active|ativo|available|disponivel|disponível){edge}")
    return ~off & ~gone & (F.coalesce(flag == "true", F.lit(False)) | on)


def specific_url(doc: Column) -> Column:
    """The direct or the auction address, whichever tells of one listing, the direct one first."""
    direct, auction, code = text(doc, DIRECT), text(doc, AUCTION), text(doc, CODES)
    fits = lambda u: F.coalesce(F.contains(u, code), F.lit(False)) | u.rlike(r"(?i)/(imovel|lote|sale/detail|detail|codigo-|id=|cod=)")
    return F.when(fits(direct), direct).when(fits(auction), auction).otherwise(F.coalesce(direct, auction))


def candidates(docs: DataFrame) -> DataFrame:
    """Listing candidates of docs(doc JSON); those without id or address go."""
    d = F.col("doc")
    images = strings(d, IMAGES)
    place = F.coalesce(text(d, HOOD), text(d, CITY), F.lit("localização não informada"))
    title = F.coalesce(text(d, TITLE), text(d, ("descricao", "description")), F.concat(F.coalesce(text(d, TYPE), F.lit("Imóvel")), F.lit(" em "), place))
    rows = docs.select(
        text(d, ID).alias("id"), title.alias("title"), F.coalesce(text(d, IMAGE), F.get(images, 0)).alias("image_url"), specific_url(d).alias("href"), text(d, HOOD).alias("neighborhood"), text(d, CITY).alias("city"),
        text(d, STATE).alias("state"), number(d, PRICE).alias("price"), number(d, AREA).alias("usable_area"), number(d, BEDS).alias("bedrooms"), number(d, BATHS).alias("bathrooms"), number(d, PARKING).alias("parking_spaces"),
        text(d, TYPE).alias("property_type"), text(d, TRANSACTION).alias("transaction"), text(d, DESCRIPTION).alias("description"), text(d, ADDRESS).alias("address"), strings(d, AMENITIES).alias("amenities"), "doc",
    )
    return rows.where("id is not null and href is not null")


def _like(c: Column, value: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(value.lower())), F.lit(False))


def prefilter(docs: DataFrame, layout: str, city: str, state: str, neighborhood: str | None = None, min_price=None, max_price=None) -> DataFrame:
    """Documents that may fit a request: exact variants of city and state, `ativo` and price in the `imoveis` layout; else availability marks and any place field that holds a wanted name."""
    d = F.col("doc")
    if layout == "imoveis":
        forms = lambda v: sorted({v.strip(), v.strip().upper(), v.strip().lower()})
        rows = docs.where((field(d, "ativo") == "true") & field(d, "cidade").isin(*forms(city)) & field(d, "estado").isin(*forms(state)))
        price = field(d, "preco_venda").try_cast("double")
        rows = rows if min_price is None else rows.where(price >= min_price)
        return rows if max_price is None else rows.where(price <= max_price)
    marks = (field(d, "ativo") == "true") | (field(d, "active") == "true") | field(d, "status").isin("ACTIVE", "active")
    gone = F.coalesce(field(d, "situacao").rlike("(?i)indisponivel|indisponível|vendido|encerrado|cancelado|desativado"), F.lit(False))
    places = [(CITY, city), ((*STATE, "endereco"), state)] + ([((*HOOD, "endereco", "descricao"), neighborhood)] if neighborhood else [])
    any_place = F.lit(False)
    for names, value in places:
        for n in names:
            any_place = any_place | _like(field(d, n), value)
    return docs.where(F.coalesce(marks, F.lit(False)) & ~gone & any_place)


def collector_prefilter(docs: DataFrame, city: str, state: str, neighborhood: str | None = None) -> DataFrame:
    """The collector's variant: folded upper-case city, upper-case state, not marked off, the neighbourhood in one of three fields."""
    d = F.col("doc")
    folded = F.regexp_replace(fold_upper(F.lit(city)), r"[^\x00-\x7F]", "")
    rows = docs.where((field(d, "cidade") == folded) & (field(d, "estado") == state.strip().upper()) & F.coalesce(field(d, "ativo") != "false", F.lit(True)))
    if neighborhood:
        rows = rows.where(_like(field(d, "bairro"), neighborhood) | _like(field(d, "endereco"), neighborhood) | _like(field(d, "descricao"), neighborhood))
    return rows


def document_type(c: Column) -> Column:
    u = F.upper(strip_marks(F.coalesce(c, F.lit(""))))
    has = lambda *w: u.rlike("|".join(w))
    return (
        F.when(has("APART"), "APARTMENT").when(has("COBERTURA"), "PENTHOUSE").when(has("CASA", "SOBRADO"), "HOUSE").when(has("SALA"), "COMMERCIAL_ROOM").when(has("COMERCIAL", "LOJA", "GALPAO"), "COMMERCIAL").otherwise("OTHER")
    )


def collector_rows(docs: DataFrame, transaction: str = "SALE", source: str = "INTERNAL") -> DataFrame:
    """Collector rows of documents. A document without an id is dropped (it has no key)."""
    c = candidates(docs)
    kind = document_type(F.col("property_type"))
    price = F.col("price")
    return c.select(
        F.lit(source).alias("source"), F.col("id").alias("source_id"), F.coalesce(text(F.col("doc"), TITLE), title_of(kind, F.col("bedrooms"), F.col("neighborhood"), F.col("city"))).alias("title"), "description", F.col("href").alias("url"),
        "image_url", "city", "state", "neighborhood", F.col("address").alias("street"), F.when(F.lit(transaction != "RENT"), price).alias("sale_price"), F.when(F.lit(transaction == "RENT"), price).alias("rental_price"),
        "usable_area", F.col("bedrooms").cast("int").alias("bedrooms"), F.col("bathrooms").cast("int").alias("bathrooms"), F.col("parking_spaces").cast("int").alias("parking_spaces"), kind.alias("property_type"),
    )


def search(docs: DataFrame, requests: DataFrame, k: int = 6, layout: str = "other") -> DataFrame:
    """The k best available candidates of each of requests(search_id, city, state, neighborhood, transaction, property_type, min_price, ...), scored, best first. The `imoveis` layout
    meets a request's city, state and prices as prefilter() does; others its folded state."""
    found = candidates(docs.where(available(F.col("doc"))))
    if layout == "imoveis":
        return compatibility_top(found.drop("doc"), requests, k, "id")
    at = slugify(F.col("state"))
    p, s = scoring.prepared_texts(found).withColumn("_at", at).alias("p"), scoring.prepared_texts(requests).withColumn("_at", at).alias("s")
    pairs = p.join(s, F.col("p._at") == F.col("s._at"))
    scored = pairs.select("s.search_id", scoring.compatibility().alias("score"), *[F.col(f"p.{c}") for c in found.columns if c != "doc"])
    return top_n(scored.where("score > 0"), ["search_id"], [F.desc("score"), "id"], k)
