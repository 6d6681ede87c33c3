"""What to fetch: municipalities, portals and their search addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.enums import STATE_SLUGS
from ..functions.text import fold_lower, slugify

# Path words of property types per portal.
VIVAREAL_TYPES = {"APARTMENT": "apartamento_residencial", "HOUSE": "casa_residencial", "PENTHOUSE": "cobertura_residencial", "COMMERCIAL_ROOM": "sala_comercial", "COMMERCIAL": "imovel_comercial"}
ZAP_TYPES = {"APARTMENT": "apartamentos", "HOUSE": "casas", "PENTHOUSE": "coberturas", "COMMERCIAL_ROOM": "salas-comerciais", "COMMERCIAL": "imoveis-comerciais"}
SINGLE_TYPES = {"APARTMENT": "apartamento", "HOUSE": "casa", "PENTHOUSE": "cobertura", "COMMERCIAL_ROOM": "sala-comercial", "COMMERCIAL": "imovel-comercial"}
CHAVES_TYPES = {"APARTMENT": "apartamentos", "HOUSE": "casas"}
PORTALS = ("VIVAREAL", "ZAP", "IMOVELWEB", "CASAMINEIRA", "QUINTOANDAR", "OLX", "LOPES", "CHAVESNAMAO")


def municipality_match(requests: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Adds `municipality`, the canonical name in municipalities(state, name), null if the state has none of that folded name."""
    known = municipalities.groupBy(F.upper("state").alias("_state"), fold_lower(F.col("name")).alias("_name")).agg(F.min("name").alias("municipality"))
    rows = requests.withColumns({"_state": F.upper(F.trim("state")), "_name": fold_lower(F.col("city"))})
    return rows.join(known, ["_state", "_name"], "left").drop("_state", "_name")


def autocomplete(municipalities: DataFrame, queries: DataFrame, limit: int = 12) -> DataFrame:
    """query, name, state, rn: names that contain the folded query of 2 characters or more, those that start with it first, then in the order of Portuguese (ICU: letters before accents before case). queries are a stated set, matched by the 2-grams of both sides."""
    limit = min(max(int(limit), 1), 20)
    q = queries.select("query", fold_lower(F.col("query")).alias("_q")).where(F.length("_q") >= 2)
    m = municipalities.select("name", "state", fold_lower(F.col("name")).alias("_n")).where(F.length("_n") >= 2)
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_n") - 1), lambda i: F.substring(F.col("_n"), i, F.lit(2)))))
    pairs = m.withColumn("_g", grams).join(q.withColumn("_g", F.substring("_q", 1, 2)), "_g").where(F.contains("_n", F.col("_q")))
    w = Window.partitionBy("query").orderBy(~F.startswith("_n", F.col("_q")), F.collate("name", "pt"), "name", "state")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("query", "name", "state", "rn")


def _word(words: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.coalesce(F.upper(c), F.lit(""))]


def _number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0+$", "")


def _query(pairs: list[tuple[str, Column]]) -> Column:
    got = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{name}="), _number(value)) for name, value in pairs])), "&")
    return F.when(got != "", F.concat(F.lit("?"), got)).otherwise("")


def _join(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])


def search_url(portal: Column) -> Column:
    """The search address of a portal for request columns city, state, neighborhood, transaction, property_type, min_price, max_price, min_area, max_area, bedrooms."""
    c = F.col
    city, hood, state = slugify(c("city")), slugify(c("neighborhood")), F.lower("state")
    rent = c("transaction") == "RENT"
    action = F.when(rent, "aluguel").otherwise("venda")
    kind = c("property_type")
    prices, areas = [("precoMinimo", c("min_price")), ("precoMaximo", c("max_price"))], [("areaMinima", c("min_area")), ("areaMaxima", c("max_area"))]
    query, short = _query([*prices, ("quartos", c("bedrooms")), *areas]), _query([*prices, *areas])
    state_slug = F.coalesce(_word(STATE_SLUGS, c("state")), slugify(c("state")))
    hoods = F.when(hood != "", F.concat(F.lit("bairros/"), hood))
    zap = F.coalesce(_word(ZAP_TYPES, kind), F.lit("imoveis"))
    one = _word(SINGLE_TYPES, kind)
    urls = {
        "VIVAREAL": F.concat(F.lit("https://www.vivareal.com.br/"), F.concat_ws("/", action, state_slug, city, hoods, _word(VIVAREAL_TYPES, kind)), F.lit("/"), query),
        "ZAP": F.concat(F.lit("https://www.zapimoveis.com.br/"), action, F.lit("/"), zap, F.lit("/"), F.url_encode(_join("+", state, city, hood)), F.lit("/"), short),
        "IMOVELWEB": F.concat(F.lit("https://www.imovelweb.com.br/"), zap, F.lit("-"), action, F.lit("-"), _join("-", hood, city, state), F.lit(".html")),
        "CASAMINEIRA": F.concat(F.lit("https://www.casamineira.com.br/"), action, F.lit("/imovel/"), city, F.lit("_"), state),
        "QUINTOANDAR": F.concat(F.lit("https://www.quintoandar.com.br/"), F.when(rent, "alugar").otherwise("comprar"), F.lit("/imovel/"), _join("-", hood, city, state, F.lit("brasil")), F.coalesce(F.concat(F.lit("/"), one), F.lit(""))),
        "OLX": F.concat(F.lit("https://www.olx.com.br/imoveis/"), action, F.coalesce(F.concat(F.lit("/"), _word(ZAP_TYPES, kind)), F.lit("")), F.lit("/estado-"), state, F.lit("/"), city, F.lit("-e-regiao")),
        "LOPES": F.concat(F.lit("https://www.lopes.com.br/busca/"), action, F.lit("/br/"), state, F.lit("/"), city, F.coalesce(F.concat(F.lit("/tipo/"), one), F.lit(""))),
        "CHAVESNAMAO": F.concat(F.lit("https://www.chavesnamao.com.br/"), F.coalesce(_word(CHAVES_TYPES, kind), F.lit("imoveis")), F.lit("-"), F.when(rent, "para-alugar").otherwise("a-venda"), F.lit("/"), state, F.lit("-"), city, F.lit("/")),
    }
    out = F.lit(None).cast("string")
    for name, url in urls.items():
        out = F.when(portal == name, url).otherwise(out)
    return out


def frontier(requests: DataFrame, portals: tuple[str, ...] = PORTALS) -> DataFrame:
    """A row (portal, url) for each request and enabled portal; the portals are a fixed list, exploded in place."""
    rows = requests.withColumn("portal", F.explode(F.array(*map(F.lit, portals))))
    return rows.withColumn("url", search_url(F.col("portal")))
