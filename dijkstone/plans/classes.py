"""Rules over texts and codes. Sentences of notices are made from keys of the tables, so every rule is met."""

from pyspark.sql import functions as F

from dijkstone.operators import classify as C
from dijkstone.plans.registry import query

TITLES = [
    "Verleende vergunning voor een steiger aan de kade", "Aanvraag ingekomen: carport", "Iets over de Brink", "Rectificatie van een eerder bericht", "De beslistermijn is verlengd: verlenging beslistermijn",
    "Intrekking van een vergunning", "Weigering voor een dakopbouw", "Voornemen tot een zonneveld", "Geaccepteerde melding", "Melding van een sloop", "Algemene kennisgeving", "Van rechtswege: aanbouw", "",
]
LABELS = ["verleend", "aanvraag", "overig", "rectificatie", "verlenging_beslistermijn", "ingetrokken", "geweigerd", "ontwerp", "melding_geaccepteerd", "melding", "kennisgeving", "van_rechtswege", None]


def _listed(df, key, values):
    """One of the listed texts for each row, by its key."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values)).cast("int"))


def _sql_list(values):
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("cls01_decision_from_title", f"SELECT o_orderkey, ({_sql_list(LABELS)})[o_orderkey % {len(LABELS)} + 1] AS decision FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.decision_from_title(_listed(t.orders, "o_orderkey", TITLES)).alias("decision"))


BODIES = [
    "Na afweging van de belangen: de omgevingsvergunning is geweigerd.", "Het verzoek van de bewoner is buiten behandeling gelaten.", "U hoort van ons zodra de vergunning is verleend.", "Kenmerk 12\nBesluit : akkoord\nEinde",
    "Besluit: nog open", "Op de markt is het morgen druk.", "Het college heeft besloten de omgevingsvergunning niet te verlenen.", "Het college heeft besloten om de vergunning te verlenen.", "Betreft een schuur\nOntvangstdatum : 3 mei",
]
BODY_LABELS = ["geweigerd", "buiten_behandeling", None, "verleend", None, None, "geweigerd", "verleend", "aanvraag"]


@query("cls02_decision_from_body", f"SELECT o_orderkey, ({_sql_list(BODY_LABELS)})[o_orderkey % {len(BODIES)} + 1] AS decision FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.decision_from_body(_listed(t.orders, "o_orderkey", BODIES)).alias("decision"))


@query("cls03_address", "SELECT c_custkey, 'Lange Laan' AS street, (c_custkey % 300 + 1)::VARCHAR AS number, (1000 + c_custkey % 9000) || 'AB' AS postcode, 'Eibergen' AS place FROM customer")
def _(t):
    k = F.col("c_custkey")
    title = F.concat(F.lit("Lange Laan "), (k % 300 + 1).cast("string"), F.lit(", "), (k % 9000 + 1000).cast("string"), F.lit(" AB Eibergen"))
    return t.customer.select("c_custkey", C.address(title).alias("a")).select("c_custkey", "a.street", "a.number", "a.postcode", "a.place")


@query(
    "cls04_case_number",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'KM-Z2031-' || lpad((o_orderkey % 100000)::VARCHAR, 7, '0') WHEN 1 THEN 'brug/' || o_orderkey || '.7' WHEN 2 THEN NULL WHEN 3 THEN '2031K' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') ELSE 'p' || o_orderkey || '-x' END AS case_number FROM orders",
)
def _(t):
    k = F.col("o_orderkey")
    s, padded = k.cast("string"), lambda n, w: F.lpad((k % n).cast("string"), w, "0")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Over de steiger, bekend als KM-Z2031-"), padded(100000, 7), F.lit(", is besloten")))
        .when(k % 5 == 1, F.concat(F.lit("In dit dossiernr. vindt u niets; zie kenmerk brug/"), s, F.lit(".7; en verder")))
        .when(k % 5 == 2, F.lit("Kenmerk onbekend, aanvraagnummer volgt"))
        .when(k % 5 == 3, F.concat(F.lit("Stuk 2031K"), padded(10000, 4), F.lit(" ligt ter inzage")))
        .otherwise(F.concat(F.lit("Uw referentie: p"), s, F.lit("-x")))
    )
    return t.orders.select("o_orderkey", C.case_number(text).alias("case_number"))


@query("cls05_received_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS received FROM orders")
def _(t):
    months = F.array(*[F.lit(m) for m in list(C.MONTHS)[:12]])
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    worded = F.concat(F.lit("ontvangen op grond van de APV. Ontvangen op "), F.dayofmonth(d).cast("string"), F.lit(" "), F.get(months, F.month(d) - 1), F.lit(" "), F.year(d).cast("string"))
    text = F.when(k % 3 == 0, F.concat(F.lit("Datum ontvangst: "), F.date_format(d, "dd-MM-yyyy"))).when(k % 3 == 1, worded).otherwise("ontvangen op 99-99-2024")
    return t.orders.select("o_orderkey", C.received_date(text).alias("received"))


@query("cls06_deviation", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'waarschijnlijk' ELSE 'onbekend' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'titel' WHEN 1 THEN 'tekst' END AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'uitgebreid' ELSE 'regulier' END AS procedure FROM orders")
def _(t):
    k = F.col("o_orderkey")
    title = F.when(k % 3 == 0, "Buitenplanse omgevingsplanactiviteit").otherwise("Dakkapel")
    body = F.concat(F.when(k % 3 == 1, "afwijken van het omgevingsplan. ").otherwise(""), F.when(k % 2 == 0, "uitgebreide procedure").otherwise(""))
    return t.orders.select("o_orderkey", C.deviation(title, body).alias("d")).select("o_orderkey", "d.*")


@query("cls07_provision_kind", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'begrippen' WHEN 1 THEN 'vergunningplicht' WHEN 2 THEN 'begrippen' END AS kind FROM part")
def _(t):
    rules = [(r"(begripsbepaling(en)?|begrippen)", "begrippen"), (r"(omgevings)?vergunningplicht.*", "vergunningplicht")]
    heading = _listed(t.part, "p_partkey", ["Begrippen ", "Bouwen: Vergunningplicht", "Bégrippen: overig", "Iets anders"])
    return t.part.select("p_partkey", C.provision_kind(heading, rules).alias("kind"))


@query("cls08_path_labels", "SELECT p_partkey, 'water en bodem > ' || p_name AS key, CASE WHEN length(p_name) < 14 THEN p_name ELSE 'Water en bodem' END AS label FROM part")
def _(t):
    path = F.concat(F.lit("2.1 Water én bodem > "), F.col("p_name"))
    return t.part.select("p_partkey", C.path_key(path).alias("key"), C.path_label(F.array(F.lit("Hoofdstuk 2"), F.lit("Water en bodem"), F.when(F.length("p_name") < 14, F.col("p_name")).otherwise("Hoofdstuk 22")), ["hoofdstuk", "afdeling"]).alias("label"))


@query("cls09_first_known", "SELECT d.doc_id, coalesce(l.toxic::VARCHAR, CASE WHEN lang = 'es' THEN 'hand' END, 'rule') AS said FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return d.select("doc_id", C.first_known(F.col("toxic").cast("string"), F.when(F.col("lang") == "es", "hand"), F.lit("rule")).alias("said"))


@query("cls10_fingerprint", "SELECT p_partkey, sha256(p_name || chr(31) || p_brand || chr(31) || p_size) AS fingerprint FROM part")
def _(t):
    return C.fingerprint(t.part, ["p_name", "p_brand", "p_size"], "p_partkey")


@query("cls11_measurements", "SELECT p_partkey, p_size + 0.5 AS height, p_size::DOUBLE AS share FROM part")
def _(t):
    said = F.concat(F.lit('"Maximum hoogte (m)"="'), F.col("p_size").cast("string"), F.lit(',5"  "Aandeel (pct)"="'), F.col("p_size").cast("string"), F.lit('"'))
    m = t.part.select("p_partkey", C.measurements(said).alias("m"))
    return m.select("p_partkey", F.col("m")["maximum_hoogte_m"].alias("height"), F.col("m")["aandeel_pct"].alias("share"))


@query("cls12_units", "SELECT p_partkey, CASE WHEN p_name LIKE '%_pct' THEN 'procent' WHEN p_name LIKE '%_m2' THEN 'vierkante meter' WHEN p_name LIKE '%_m3' THEN 'kubieke meter' WHEN p_name LIKE '%_ha' THEN 'hectare' WHEN p_name LIKE '%_g' THEN NULL WHEN p_name LIKE '%_m' THEN 'meter' END AS unit FROM part")
def _(t):
    return t.part.select("p_partkey", C.unit_of(F.col("p_name")).alias("unit"))


@query("cls13_inline_references", "SELECT page_id, (i - 1)::INTEGER AS position, CASE i WHEN 1 THEN 'IntRef' ELSE 'ExtIoRef' END AS kind, CASE i WHEN 1 THEN 'a' || page_id ELSE '/join/' || page_id END AS target, CASE i WHEN 2 THEN 'w' || page_id END AS own_id FROM pages, range(1, 3) r(i)")
def _(t):
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("<p>zie <IntRef ref=\"a"), k, F.lit("\">x</IntRef> en <ExtIoRef wId='w"), k, F.lit("' ref='/join/"), k, F.lit("'>y</ExtIoRef> <IntIoRef/></p>"))
    return C.inline_references(t.pages.select("page_id", text.alias("text")), "text").select("page_id", "position", "kind", "target", "own_id")


@query("cls14_links", "SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, true AS valid FROM pages")
def _(t):
    return t.pages.select("page_id", C.link_parts(F.col("url")).alias("l")).select("page_id", "l.host", "l.path", "l.valid")


@query("cls15_mapped_codes", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'bouw' WHEN 'MACHINERY' THEN 'techniek' ELSE 'overig' END AS function FROM customer")
def _(t):
    return t.customer.select("c_custkey", C.mapped(F.col("c_mktsegment"), {"BUILDING": "bouw", "MACHINERY": "techniek"}, F.lit("overig")).alias("function"))


@query("cls16_canonical_line", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Overig' WHEN p_brand = 'Brand#1' THEN 'Eerste' ELSE lower(p_brand) END AS line FROM part")
def _(t):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, " - ").otherwise("")).otherwise(F.concat(F.lit(" "), F.col("p_brand")))
    return t.part.select("p_partkey", C.canonical_line(raw, {"brand#1": "Eerste"}).alias("line"))


@query("cls17_tiers", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'gemeente' WHEN 1 THEN 'provincie' WHEN 2 THEN 'waterschap' ELSE 'rijk' END AS tier FROM customer")
def _(t):
    return t.customer.select("c_custkey", C.authority_tier(F.concat(_listed(t.customer, "c_custkey", ["gm", "pv", "ws", "mnre"]), F.col("c_custkey").cast("string"))).alias("tier"))


@query(
    "cls18_bands",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'stop' WHEN p_size > 10 THEN 'warn' ELSE 'ok' END AS air, CASE WHEN p_size + 25 > 65 THEN 'stop' WHEN p_size + 25 > 55 THEN 'warn' ELSE 'ok' END AS noise,
       CASE p_size % 8 WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' WHEN 3 THEN 'warn' WHEN 4 THEN 'stop' WHEN 5 THEN 'stop' WHEN 6 THEN 'ok' END AS flood, CASE p_partkey % 3 WHEN 0 THEN 'Zand' WHEN 1 THEN 'Veen' ELSE 'Overig' END AS soil FROM part""",
)
def _(t):
    size = F.col("p_size").cast("double")
    return t.part.select(
        "p_partkey", C.air_band("no2", size).alias("air"), C.noise_band(size + 25).alias("noise"), C.flood_class((F.col("p_size") % 8).cast("double"))["band"].alias("flood"),
        C.soil_kind(_listed(t.part, "p_partkey", ["lemig Zand", "Moerige grond op klei", "Bebouwing"])).alias("soil"),
    )


@query("cls19_version_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS valid_from FROM orders")
def _(t):
    e = F.concat(F.lit("/akn/nl/act/gm0001/x/nld@"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("v2"))
    return t.orders.select("o_orderkey", C.version_date(e).alias("valid_from"))


@query(
    "cls20_relevant_drafts",
    "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> c_custkey % 7 AND (o_orderkey % 5 = 0 OR o_orderdate::DATE >= DATE '1997-01-01')",
)
def _(t):
    drafts = t.orders.select("o_orderkey", F.col("o_custkey").alias("work"), (F.col("o_orderkey") % 7).alias("new_expression"), F.when(F.col("o_orderkey") % 5 == 0, "onbekend").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("effective"), F.lit(None).cast("bigint").alias("based_on"))
    now = t.customer.select(F.col("c_custkey").alias("work"), (F.col("c_custkey") % 7).alias("expression"))
    return C.relevant_drafts(drafts, now, F.to_date(F.lit("1997-01-01"))).select("o_orderkey")


@query(
    "cls21_superseded",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ingetrokken' WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 THEN 'actief' ELSE 'inactief' END AS status FROM orders""",
)
def _(t):
    v = t.orders.select("o_orderkey", "o_custkey", F.concat(F.lit("x@"), F.col("o_orderkey").cast("string")).alias("e"), F.when(F.col("o_orderstatus") == "P", "ingetrokken").otherwise("nieuw").alias("status"))
    return C.supersede(v, "o_custkey", "e", "status").select("o_orderkey", "status")
