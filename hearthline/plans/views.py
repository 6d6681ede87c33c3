"""Domain-shaped views over the star-schema tables, in SQL that Spark and DuckDB share. Tables stand in braces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_snapshot": """
        SELECT concat('src', CAST(l_suppkey % 7 AS STRING)) AS source_code,
               CAST(l_partkey AS STRING) AS external_id, l_partkey AS property_id,
               l_shipdate AS captured_at,
               CAST(MIN(l_extendedprice) AS DECIMAL(14,2)) AS price,
               CAST(floor(MIN(l_tax) * 10000) AS DECIMAL(14,2)) AS condo_fee,
               MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 AS active
        FROM {lineitem}
        GROUP BY concat('src', CAST(l_suppkey % 7 AS STRING)), CAST(l_partkey AS STRING), l_partkey, l_shipdate""",
    "v_listing": """
        SELECT concat(source_code, '-', external_id) AS listing_id, property_id, source_code, external_id,
               concat('https://', source_code, '.example/imovel/', external_id) AS url,
               price, condo_fee, active, captured_at
        FROM (SELECT s.*, row_number() OVER (PARTITION BY source_code, external_id ORDER BY captured_at DESC) AS rn
              FROM v_snapshot s) t
        WHERE rn = 1""",
    "v_property": """
        SELECT p_partkey AS property_id, p_name AS title,
               CASE p_type WHEN 'ECONOMY' THEN 'APARTMENT' WHEN 'SMALL' THEN 'HOUSE' WHEN 'MEDIUM' THEN 'PENTHOUSE'
                           WHEN 'LARGE' THEN 'COMMERCIAL' WHEN 'PROMO' THEN 'COMMERCIAL_ROOM' ELSE 'OTHER' END AS property_type,
               CASE WHEN p_partkey % 3 = 0 THEN 'RENT' ELSE 'SALE' END AS transaction_type,
               n_name AS city, r_name AS state, p_brand AS neighborhood,
               lower(concat('rua ', p_name, ', ', CAST(p_size AS STRING))) AS normalized_address,
               CAST(p_size * 4 AS DOUBLE) AS area_m2,
               CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 5 END AS bedrooms,
               p_size % 4 AS bathrooms, CAST(p_partkey % 3 AS INT) AS parking_spaces
        FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25 JOIN {region} ON r_regionkey = n_regionkey""",
    "v_incoming": """
        SELECT property_id + 1000000 AS incoming_id, lower(city) AS city, upper(neighborhood) AS neighborhood,
               CASE property_id % 4 WHEN 0 THEN normalized_address
                    WHEN 1 THEN concat(CAST(CAST(area_m2 / 4 AS INT) AS STRING), ' ', title, ' - RUA')
                    WHEN 2 THEN concat(normalized_address, ' bloco b') ELSE NULL END AS normalized_address,
               area_m2 + property_id % 5 AS area_m2,
               CASE WHEN property_id % 7 = 0 THEN NULL ELSE bedrooms END AS bedrooms, parking_spaces
        FROM v_property""",
    "v_search": """
        SELECT o_orderkey AS search_id, n_name AS city, r_name AS state,
               CASE WHEN o_orderkey % 3 = 0 THEN 'RENT' ELSE 'SALE' END AS transaction_type,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOUSE' WHEN 'BUILDING' THEN 'APARTMENT' ELSE NULL END AS property_type,
               CAST(floor(o_totalprice * 0.01) AS DECIMAL(14,2)) AS price_min,
               CAST(floor(o_totalprice * 0.25) AS DECIMAL(14,2)) AS price_max,
               CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE CAST(o_custkey % 60 AS DOUBLE) END AS area_min,
               CAST(o_custkey % 3 AS INT) AS bedrooms_min, CAST(NULL AS INT) AS parking_spaces_min
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
             JOIN {region} ON r_regionkey = n_regionkey""",
    # the stated queries of the jobs that hold searches against all properties
    "v_query": """
        SELECT * FROM v_search WHERE search_id % 20 = 0""",
    "v_collector": """
        SELECT l.property_id * 7 + CAST(substring(l.source_code, 4) AS BIGINT) AS id, l.source_code AS source,
               l.external_id AS source_id, p.title,
               CASE WHEN p.transaction_type = 'SALE' THEN l.price END AS sale_price,
               CASE WHEN p.transaction_type = 'RENT' THEN l.price END AS rental_price,
               p.city, p.state, p.neighborhood, p.normalized_address AS street, p.bedrooms, p.bathrooms, p.parking_spaces,
               CASE WHEN l.property_id % 13 = 0 THEN NULL ELSE p.area_m2 END AS usable_area, p.property_type, l.url,
               CASE WHEN l.active THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, l.captured_at AS updated_at
        FROM v_listing l JOIN v_property p ON p.property_id = l.property_id""",
    "v_ad": """
        SELECT doc_id AS seq, source, CAST(doc_id AS STRING) AS source_id, text AS description,
               lang AS city, lang AS state, 'APARTMENT' AS property_type, CAST(NULL AS STRING) AS street,
               'centro' AS neighborhood, CAST(100 AS DECIMAL(14,2)) AS sale_price, CAST(NULL AS DECIMAL(14,2)) AS rental_price,
               CAST(80 + doc_id % 3 AS DOUBLE) AS usable_area, CAST(doc_id % 3 AS INT) AS bedrooms,
               CAST(NULL AS INT) AS bathrooms, CAST(doc_id % 2 AS INT) AS parking_spaces, CAST(NULL AS INT) AS suites
        FROM {documents}""",
    "v_psearch": """
        SELECT o_orderkey AS search_id, concat('k', CAST(o_custkey % 300 AS STRING)) AS search_key,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'PENDING' END END AS status,
               CAST(o_orderkey % 5 AS INT) AS attempts, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' HOUR END AS last_heartbeat_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '2' HOUR END AS completed_at,
               CASE WHEN o_orderkey % 6 = 1 THEN o_orderdate + INTERVAL '5' DAY END AS next_attempt_at,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate + INTERVAL '10' MINUTE END AS started_at,
               o_orderdate + INTERVAL '3' HOUR AS updated_at,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '2' HOUR END AS collection_finished_at,
               CASE WHEN o_orderstatus = 'F' OR o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL '2' HOUR END AS last_collected_at,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate + INTERVAL '20' DAY END AS lock_expires_at
        FROM {orders}""",
    "v_request": """
        SELECT event_id AS request_id, concat('k', CAST(user_id % 300 AS STRING)) AS search_key, ts AS requested_at
        FROM {events} WHERE event_type = 'view'""",
    "v_run": """
        SELECT event_type AS scope_id, CAST(date_trunc('day', ts) AS DATE) AS run_day,
               COUNT(DISTINCT user_id) AS listings_found,
               CASE WHEN day(CAST(date_trunc('day', ts) AS DATE)) % 7 = 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
               CASE WHEN day(CAST(date_trunc('day', ts) AS DATE)) % 5 = 0 THEN 'INCREMENTAL' ELSE 'FULL' END AS run_type
        FROM {events} GROUP BY event_type, CAST(date_trunc('day', ts) AS DATE)""",
    "v_seen": """
        SELECT DISTINCT user_id AS listing_id, event_type AS scope_id, CAST(date_trunc('day', ts) AS DATE) AS run_day
        FROM {events}""",
    "v_outbox": """
        SELECT event_id AS outbox_id, concat('doc-', CAST(user_id AS STRING)) AS document_id,
               CASE event_type WHEN 'error' THEN 'DELETE' ELSE 'UPSERT' END AS operation,
               CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'PENDING' END AS status,
               CAST(event_id % 7 AS INT) AS attempts, ts AS created_at
        FROM {events}""",
    "v_result": """
        SELECT DISTINCT l_orderkey AS search_id, l_partkey AS property_id FROM {lineitem}""",
}


def needed(*names: str) -> list[str]:
    """The views that these need, each after those it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        for other in re.findall(r"\bv_\w+", VIEWS[name]):
            if other != name:
                visit(other)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    chain = needed(name)
    text = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in chain) + f"\nSELECT * FROM {name}"
    tables = {t: table(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", text))}
    return spark.sql(text, **tables)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not names:
        return sql
    chain = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in needed(*names))
    rest = sql.strip()
    return f"WITH RECURSIVE {chain},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {chain}\n{rest}"
