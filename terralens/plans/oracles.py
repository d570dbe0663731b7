"""The same queries as DuckDB SQL."""

from terralens.operators.retrieval import KNOWLEDGE
from terralens.sources.readers import CATALOGUE

MASTER = """
spine AS (SELECT CASE WHEN length(c_custkey::VARCHAR) >= 5 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS cod, c_name AS municipio, c_nationkey AS departamento,
  ((c_custkey * 7919) % 1700)::DOUBLE / 100 - 4 AS lat, ((c_custkey * 104729) % 1200)::DOUBLE / 100 - 79 AS lon FROM customer),
titles AS (SELECT CASE WHEN length(o_custkey::VARCHAR) >= 5 THEN o_custkey::VARCHAR ELSE lpad(o_custkey::VARCHAR, 5, '0') END AS cod, o.*,
  ((o_orderkey * 37) % 140)::DOUBLE / 100 - 0.2 AS ica FROM orders o),
known AS (SELECT * FROM titles WHERE cod IN (SELECT cod FROM spine)),
per_code AS (SELECT cod, count(*)::INT AS mineria_titulos, count(DISTINCT nullif(trim(o_orderpriority), ''))::INT AS mineria_minerales,
  max((o_orderpriority = '1-URGENT')::INT) AS es_pdet, max(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice / 100) END) AS deforestacion_ha,
  sum(CASE WHEN o_orderkey % 7 = 0 AND ica BETWEEN 0 AND 1 THEN (o_orderkey * 37) % 140 - 20 END)::DOUBLE AS ica_sum,
  count(CASE WHEN o_orderkey % 7 = 0 AND ica BETWEEN 0 AND 1 THEN 1 END)::INT AS agua_estaciones,
  count(CASE WHEN o_orderstatus = 'F' THEN 1 END)::INT AS runap_areas,
  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,4) END)::DOUBLE AS runap_hectareas FROM known GROUP BY cod),
volume AS (SELECT cod, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS mineria_volumen, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS mineria_regalias
  FROM known JOIN lineitem ON o_orderkey = l_orderkey GROUP BY cod),
master AS (SELECT s.cod AS cod_mpio, municipio, departamento, lat, lon, coalesce(mineria_titulos, 0) AS mineria_titulos, coalesce(mineria_minerales, 0) AS mineria_minerales,
  floor(coalesce(mineria_volumen, 0) * 100 + 0.5) / 100 AS mineria_volumen, floor(coalesce(mineria_regalias, 0) * 100 + 0.5) / 100 AS mineria_regalias,
  coalesce(es_pdet, 0) AS es_pdet, coalesce(deforestacion_ha, 0) AS deforestacion_ha,
  CASE WHEN agua_estaciones > 0 THEN floor(ica_sum / (agua_estaciones::DOUBLE * 100) * 1e4 + 0.5) / 1e4 END AS agua_ica_medio,
  coalesce(agua_estaciones, 0) AS agua_estaciones, coalesce(runap_areas, 0) AS runap_areas, floor(coalesce(runap_hectareas, 0) * 100 + 0.5) / 100 AS runap_hectareas
  FROM spine s LEFT JOIN per_code p ON s.cod = p.cod LEFT JOIN volume v ON s.cod = v.cod)"""

HOT = """
hot AS (SELECT event_id, event_type AS sensor, value AS frp, ts::DATE AS acq_date, ((event_id * 7919) % 1700)::DOUBLE / 100 - 4 AS lat,
  ((event_id * 104729) % 1200)::DOUBLE / 100 - 79 AS lon, CASE WHEN length(user_id::VARCHAR) >= 5 THEN user_id::VARCHAR ELSE lpad(user_id::VARCHAR, 5, '0') END AS cod FROM events),
recent AS (SELECT * FROM hot WHERE acq_date > (SELECT max(acq_date) FROM hot) - 7),
fire AS (SELECT cod AS cod_mpio, count(*)::INT AS focos_7d, sum(frp::DECIMAL(18,4))::DOUBLE AS frp_total, max(acq_date) AS ultima_fecha FROM recent GROUP BY cod)"""

LABELLED = f"""{MASTER}, {HOT},
joined AS (SELECT m.*, coalesce(focos_7d, 0) AS focos_7d, coalesce(frp_total, 0) AS frp_total, mineria_titulos + mineria_volumen / 1000 AS raw_ FROM master m LEFT JOIN fire USING (cod_mpio)),
bounds AS (SELECT min(ln(1 + raw_)) AS a0, max(ln(1 + raw_)) AS a1, min(ln(1 + deforestacion_ha)) AS b0, max(ln(1 + deforestacion_ha)) AS b1,
  min(ln(1 + runap_hectareas)) AS c0, max(ln(1 + runap_hectareas)) AS c1, ln(1 + max(frp_total)) AS f1 FROM joined),
idx AS (SELECT joined.*, floor(CASE WHEN a1 > a0 THEN (ln(1 + raw_) - a0) / (a1 - a0) ELSE 0 END * 1e4 + 0.5) / 1e4 AS idx_minero,
  floor(CASE WHEN b1 > b0 THEN (ln(1 + deforestacion_ha) - b0) / (b1 - b0) ELSE 0 END * 1e4 + 0.5) / 1e4 AS idx_deforestacion,
  floor(least(1.0, ln(1 + frp_total) / coalesce(nullif(f1, 0), 1)) * 1e4 + 0.5) / 1e4 AS idx_fuego,
  coalesce(floor((1 - agua_ica_medio) * 1e4 + 0.5) / 1e4, 0) AS idx_hidrico,
  floor(CASE WHEN c1 > c0 THEN (ln(1 + runap_hectareas) - c0) / (c1 - c0) ELSE 0 END * 1e4 + 0.5) / 1e4 AS sens_ FROM joined, bounds),
idx2 AS (SELECT *, floor(least(1.0, sens_ + 0.25 * es_pdet) * 1e4 + 0.5) / 1e4 AS idx_sensibilidad, (agua_ica_medio IS NULL)::INT AS hidrico_sin_dato FROM idx),
scored AS (SELECT *, floor((0.0::DOUBLE + 0.30::DOUBLE * idx_minero + 0.25::DOUBLE * idx_deforestacion + 0.15::DOUBLE * idx_fuego + 0.20::DOUBLE * idx_hidrico + 0.10::DOUBLE * idx_sensibilidad) * 1e4 + 0.5) / 1e4 AS riesgo_score FROM idx2),
arr AS (SELECT list_sort(list(riesgo_score)) AS v, count(*) AS n FROM scored),
cuts AS (SELECT v[least(n - 1, floor(0.60 * n)::BIGINT) + 1] AS q0, v[least(n - 1, floor(0.85 * n)::BIGINT) + 1] AS q1, v[least(n - 1, floor(0.95 * n)::BIGINT) + 1] AS q2 FROM arr),
labelled AS (SELECT scored.* EXCLUDE (raw_, sens_), CASE WHEN riesgo_score >= q2 THEN 'Crítico' WHEN riesgo_score >= q1 THEN 'Alto' WHEN riesgo_score >= q0 THEN 'Medio' ELSE 'Bajo' END AS riesgo_nivel FROM scored, cuts)"""

POLY = """
poly AS (SELECT n_nationkey AS cod, ((n_nationkey::BIGINT * 7919) % 1700)::DOUBLE / 100 - 4 AS y, ((n_nationkey::BIGINT * 104729) % 1200)::DOUBLE / 100 - 79 AS x FROM nation)"""


def _edge(x1, y1, x2, y2):
    x1, y1, x2, y2 = (f"({c} + ({v}))" for c, v in (("x", x1), ("y", y1), ("x", x2), ("y", y2)))
    return f"(CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END)"


QUAD = ((-2.0, -0.5), (0.5, -2.0), (2.0, 0.5), (-0.5, 2.0))
CROSSINGS = " + ".join(_edge(*a, *b) for a, b in zip(QUAD, QUAD[1:] + QUAD[:1], strict=True))
KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lon) / 2), 2), 1.0)))"
PROBA = """
proba AS (SELECT doc_id, quality AS y, toxic, [(1 + (doc_id * 7) % 11)::DOUBLE / s, (1 + (doc_id * 5) % 13)::DOUBLE / s, (1 + (doc_id * 3) % 7)::DOUBLE / s, (1 + doc_id % 5)::DOUBLE / s] AS p FROM
  (SELECT doc_id, ((doc_id * 31) % 4)::INT AS quality, toxic, (4 + (doc_id * 7) % 11 + (doc_id * 5) % 13 + (doc_id * 3) % 7 + doc_id % 5)::DOUBLE AS s FROM labels))"""


def _w(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _qhat(source: str, group: str = "") -> str:
    by = f"GROUP BY {group}" if group else ""
    pick = f"{group}, " if group else ""
    return f"""SELECT {pick}v[ceil(least(1.0, ceil((n + 1) * 0.9::DECIMAL(10,6)) / n) * (n - 1) - 1e-9)::BIGINT + 1] AS qhat, n AS n_cal
  FROM (SELECT {pick}list_sort(list(s)) AS v, count(*) AS n FROM {source} {by})"""


PRED = "pred AS (SELECT l.doc_id, l.quality AS y, (n_chars > 400)::INT AS yhat FROM labels l JOIN documents d USING (doc_id))"
PIXELS = """
pix AS (SELECT l_orderkey % 64 AS row_, l_partkey % 64 AS col_, l_suppkey % 25 AS zone, ((l_orderkey * 13 + l_partkey * 7) % 9000)::DOUBLE AS nir0, ((l_orderkey * 5 + l_suppkey * 11) % 4000)::DOUBLE AS red0,
  ((l_orderkey * 17 + l_partkey * 3) % 9000)::DOUBLE AS nir1, ((l_orderkey * 19 + l_suppkey * 23) % 6000)::DOUBLE AS red1, l_linenumber FROM lineitem),
nd AS (SELECT *, (nir0 - red0) / (nir0 + red0 + 1e-6) AS v0, (nir1 - red1) / (nir1 + red1 + 1e-6) AS v1 FROM pix)"""

DOM = """CASE WHEN idx_minero = g THEN 'idx_minero' WHEN idx_deforestacion = g THEN 'idx_deforestacion' WHEN idx_fuego = g THEN 'idx_fuego' WHEN idx_hidrico = g THEN 'idx_hidrico' ELSE 'idx_sensibilidad' END"""

def _text(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


IDX = ("idx_minero", "idx_deforestacion", "idx_fuego", "idx_hidrico", "idx_sensibilidad")
DOMINANT = f"d AS (SELECT *, greatest({', '.join(IDX)}) AS g FROM labelled)"
NATIONS = "SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS cod, n_name AS mpio, n_regionkey::VARCHAR AS dpto FROM nation"
KB = "SELECT * FROM (VALUES " + ", ".join(f"({_text('kb-' + i)}, 'conocimiento', '', {_text(t)})" for i, t in KNOWLEDGE) + ") t(id, tipo, municipio, texto)"
CHUNKS = """SELECT doc_id || '-' || (i - 1) || CASE WHEN k > 0 THEN '.' || k ELSE '' END AS id, substr(part, (k * 1200 + 1)::BIGINT, 1200) AS texto
  FROM (SELECT *, unnest(range((length(part) - 1) // 1200 + 1)) AS k FROM (SELECT doc_id, i, trim(parts[i], ' ' || chr(9) || chr(10) || chr(13)) AS part
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)) WHERE part <> '')"""
FACTS = f"""SELECT 'mun-' || cod_mpio AS id, 'municipio' AS tipo, municipio, printf('%s, department %d: level %s, score %.4f. Indices: mining %.4f, forest %.4f, fire %.4f, water %.4f, sensitivity %.4f. %d titles, %d hot spots in seven days, %d protected areas.',
  municipio, departamento, riesgo_nivel, riesgo_score, {', '.join(IDX)}, mineria_titulos, focos_7d, runap_areas) AS texto FROM labelled"""


def _ranking(ident: str, title: str, by: str, fmt: str) -> str:
    return f"""SELECT '{ident}' AS id, 'resumen' AS tipo, '' AS municipio, '{title}: ' || string_agg(printf('%s (%s) {fmt}', municipio, departamento::VARCHAR, {by}), ', ' ORDER BY {by} DESC, cod_mpio) || '.' AS texto
  FROM (SELECT * FROM labelled ORDER BY {by} DESC, cod_mpio LIMIT 10)"""


SUMMARIES = f"""{_ranking('resumen-nacional-focos', 'Most active hot spots in seven days', 'focos_7d', '%d')} UNION ALL {_ranking('resumen-nacional-score', 'Highest priority score', 'riesgo_score', '%.4f')}
  UNION ALL SELECT 'resumen-distribucion', 'resumen', '', printf('Levels of %d territories: Crítico %d, Alto %d, Medio %d, Bajo %d. Territories with active hot spots: %d.', count(*), count(*) FILTER (riesgo_nivel = 'Crítico'),
    count(*) FILTER (riesgo_nivel = 'Alto'), count(*) FILTER (riesgo_nivel = 'Medio'), count(*) FILTER (riesgo_nivel = 'Bajo'), count(*) FILTER (focos_7d > 0)) FROM labelled
  UNION ALL SELECT 'resumen-dep-' || departamento, 'resumen', '', concat_ws(' ', 'Department ' || departamento || '.',
    'Highest priority: ' || string_agg(printf('%s (%s, score %.4f)', municipio, riesgo_nivel, riesgo_score), ', ' ORDER BY a) FILTER (a <= 6 AND high) || '.', 'Most hot spots: ' || string_agg(printf('%s %d', municipio, focos_7d), ', ' ORDER BY b) FILTER (b <= 6 AND focos_7d > 0) || '.')
    FROM (SELECT *, riesgo_nivel IN ('Alto', 'Crítico') AS high, row_number() OVER (PARTITION BY departamento, riesgo_nivel IN ('Alto', 'Crítico') ORDER BY riesgo_score DESC, cod_mpio) AS a, row_number() OVER (PARTITION BY departamento ORDER BY focos_7d DESC, cod_mpio) AS b FROM labelled)
    GROUP BY departamento HAVING bool_or(high) OR bool_or(focos_7d > 0)"""
MEANS = "m AS (SELECT " + ", ".join(f"avg({c}::DECIMAL(18,6)) AS m_{c}" for c in IDX) + " FROM labelled)"
IDX_WEIGHTS = dict(zip(IDX, ("0.3", "0.25", "0.15", "0.2", "0.1"), strict=True))
IMPORTANCES = " UNION ALL ".join(f"SELECT '{c}' AS feature, floor(avg(abs({w}::DOUBLE * ({c} - m_{c}))::DECIMAL(20,10))::DOUBLE * 1e5 + 0.5) / 1e5 AS importance FROM labelled, m" for c, w in IDX_WEIGHTS.items())
GRID = PIXELS + """, grid AS (SELECT row_::INT AS r, col_::INT AS c, max((v0 > 0.6 AND v0 - v1 > 0.15)::INT) AS lost, max(nir0) AS nir FROM nd GROUP BY ALL)"""

NEAREST = ("q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)", "s AS (SELECT vec_id, text, floor(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE)) / ((sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) + 1e-9) * (sqrt(list_dot_product(list_transform(e, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE))) + 1e-9)) * 1e4 + 0.5) / 1e4 AS score FROM embeddings JOIN documents ON doc_id = vec_id, q)")
FLAGS = "b AS (SELECT min(riesgo_score) AS lo, max(riesgo_score) AS hi, list_sort(list(riesgo_score)) AS v, count(*) AS n FROM labelled), flags AS (SELECT labelled.*, floor((riesgo_score - lo) / (hi - lo + 1e-9) * 1e4 + 0.5) / 1e4 AS score_anomalia, (riesgo_score > v[least(n - 1, floor(0.95 * n)::BIGINT) + 1])::INT AS es_anomalia FROM labelled, b)"

SQL = {
    "territory_card": _w(LABELLED, DOMINANT + f", e AS (SELECT municipio, riesgo_nivel, printf('%.4f', riesgo_score) AS score, focos_7d::VARCHAR AS focos, {DOM} AS dom, " + ", ".join(f"printf('%.4f', {c}) AS {c}" for c in IDX) + " FROM d WHERE cod_mpio = '00042')")
    + f" SELECT unnest(['municipio', 'nivel', 'score', 'focos', 'dominante', {', '.join(map(_text, IDX))}]) AS field, unnest([municipio, riesgo_nivel, score, focos, dom, {', '.join(IDX)}]) AS value FROM e",
    "conformal_coverage": _w(
        PROBA, "a AS (SELECT rep, doc_id, p, y, 1 - p[y + 1] AS s, row_number() OVER (PARTITION BY rep, y ORDER BY (doc_id * 7919 + rep * 104729) * (2 * rep + 1) % 1000003, doc_id) AS k, count(*) OVER (PARTITION BY rep, y) AS n FROM proba, range(100) t(rep))",
        "r AS (SELECT *, k <= n // 2 AS cal FROM a)", "c AS (SELECT rep, s FROM r WHERE cal)", f"q AS ({_qhat('c', 'rep')})",
        "e AS (SELECT rep, avg((p[y + 1] >= 1 - qhat)::INT) AS c, avg(len(list_filter(p, lambda v: v >= 1 - qhat))) AS z FROM r JOIN q USING (rep) WHERE NOT cal GROUP BY rep)",
    ) + " SELECT count(*) AS repeats, floor(avg(c) * 1e6 + 0.5) / 1e6 AS coverage, floor(avg(z) * 1e6 + 0.5) / 1e6 AS set_size FROM e",
    "document_chunks": CHUNKS,
    "summary_chunks": _w(LABELLED) + " " + SUMMARIES,
    "knowledge_base": KB,
    "score_flags": _w(LABELLED, FLAGS) + " SELECT cod_mpio, score_anomalia, es_anomalia FROM flags",
    "score_flags_cross": _w(LABELLED, FLAGS) + " SELECT count(*) FILTER (es_anomalia = 1) AS anomalias, count(*) FILTER (es_anomalia = 1 AND riesgo_nivel IN ('Alto', 'Crítico')) AS en_nivel_alto, count(*) FILTER (es_anomalia = 1 AND riesgo_nivel NOT IN ('Alto', 'Crítico')) AS no_priorizadas FROM flags",
    "score_flags_top10": _w(LABELLED, FLAGS) + " SELECT cod_mpio, score_anomalia FROM flags WHERE es_anomalia = 1 ORDER BY score_anomalia DESC, cod_mpio LIMIT 10",
    "embedded_batches": "SELECT item_id, floor(x / n * 1e6 + 0.5) / 1e6 AS x, floor(y / n * 1e6 + 0.5) / 1e6 AS y, floor(z / n * 1e6 + 0.5) / 1e6 AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) + 1e-9 AS n FROM (SELECT item_id, length(text)::DOUBLE AS x, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS y, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS z FROM benchmark))",
    "assistant_answer": _w(*NEAREST) + " SELECT 'Evidence:' || chr(10) || string_agg('[' || vec_id || '] ' || text, chr(10) ORDER BY score DESC, vec_id) || chr(10) || chr(10) || 'Question: Which come first?' AS answer, count(*)::INT AS sources FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 6)",
    "fact_corpus": _w(LABELLED) + f" {FACTS} UNION ALL {SUMMARIES} UNION ALL {KB} UNION ALL SELECT id, 'doc', '', texto FROM ({CHUNKS})",
    "prompt_context": _w(*NEAREST)
    + " SELECT string_agg('[' || vec_id || '] ' || text, chr(10) ORDER BY score DESC, vec_id) AS prompt FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 6)",
    "source_registry": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([*map(_text, r[:4]), "[" + ", ".join(map(_text, r[4])) + "]", *map(_text, r[5:])]) + ")" for r in CATALOGUE) + ") t(source, dimension, portal, status, expected, description, limitation)",
    "source_status": "SELECT * FROM (VALUES " + ", ".join(f"({_text(r[0])}, {_text(r[3])}, {str(r[0] in ('territory', 'pdet')).lower()}, {'(SELECT count(*) FROM nation)' if r[0] in ('territory', 'pdet') else 'NULL'}, {_text('latitud,longitud' if r[0] == 'territory' else '' if r[0] == 'pdet' else ','.join(r[4]))})" for r in CATALOGUE) + ") t(source, status, present, n, lacking)",
    "top_importances": _w(LABELLED, MEANS) + f" SELECT * FROM ({IMPORTANCES}) ORDER BY importance DESC, feature LIMIT 4",
    "shapley_importance": _w(LABELLED, MEANS) + " " + IMPORTANCES,
    "master_by_code": _w(LABELLED) + " SELECT cod_mpio, municipio, riesgo_nivel FROM labelled ORDER BY cod_mpio",
    "score_minmax": _w(LABELLED, "b AS (SELECT min(riesgo_score) AS lo, max(riesgo_score) AS hi FROM labelled)") + " SELECT cod_mpio, floor((riesgo_score - lo) / (hi - lo + 1e-9) * 1e4 + 0.5) / 1e4 AS relative FROM labelled, b",
    "coordinates_present": "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND ((c_custkey * 7919) % 1700)::DOUBLE / 100 - 4 <> 0 AND ((c_custkey * 104729) % 1200)::DOUBLE / 100 - 79 <> 0",
    "top6_per_department_focos": _w(LABELLED) + ", r AS (SELECT departamento, cod_mpio, focos_7d, row_number() OVER (PARTITION BY departamento ORDER BY focos_7d DESC, cod_mpio)::INT AS place FROM labelled WHERE focos_7d > 0) SELECT * FROM r WHERE place <= 6",
    "hotspot_windows_stream": _w(HOT) + ", d AS (SELECT event_id, sensor, frp, acq_date, unnest(range(7)) AS k FROM hot) SELECT sensor, (acq_date - k::INT) AS first_day, count(*) AS focos, sum(frp::DECIMAL(18,4))::DOUBLE AS frp_total FROM d GROUP BY ALL",
    "trace_tables": _w(LABELLED, "t AS (SELECT count(*) AS n, sum(focos_7d)::DOUBLE AS f, count(*) FILTER (focos_7d > 0) AS w, count(*) FILTER (riesgo_nivel IN ('Alto', 'Crítico')) AS h, max(riesgo_score) AS top, (count(*) = count(DISTINCT cod_mpio))::INT AS u, min((riesgo_score BETWEEN 0 AND 1)::INT) AS r, min((agua_estaciones > 0 OR idx_hidrico = 0)::INT) AS a, (count(DISTINCT riesgo_nivel) <= 4)::INT AS l, count(*) FILTER (mineria_titulos > 0) AS c0, count(*) FILTER (deforestacion_ha > 0) AS c1, count(*) FILTER (agua_estaciones > 0) AS c2, count(*) FILTER (runap_areas > 0) AS c3, count(*) FILTER (es_pdet > 0) AS c4 FROM labelled)", "u AS (SELECT unnest(['indicator', 'indicator', 'indicator', 'indicator', 'indicator', 'assertion', 'assertion', 'assertion', 'assertion', 'coverage', 'coverage', 'coverage', 'coverage', 'coverage']) AS kind, unnest(['territories', 'hot_spots', 'with_fire', 'high', 'top_score', 'keys_unique', 'scores_in_range', 'no_water_without_sample', 'four_levels', 'mining', 'forest', 'water', 'protected', 'pdet']) AS name, unnest([n::DOUBLE, f, w, h, top, u, r, a, l, floor(c0 * 100 * 100 / greatest(n, 1) + 0.5) / 100, floor(c1 * 100 * 100 / greatest(n, 1) + 0.5) / 100, floor(c2 * 100 * 100 / greatest(n, 1) + 0.5) / 100, floor(c3 * 100 * 100 / greatest(n, 1) + 0.5) / 100, floor(c4 * 100 * 100 / greatest(n, 1) + 0.5) / 100]) AS value FROM t)") + " SELECT * FROM u",
    "zonal_polygons": _w(GRID, POLY) + f", px AS (SELECT r, c, 0.2e0 * (c + 0.5e0) + 0e0 * (r + 0.5e0) + -79e0 AS lon, 0e0 * (c + 0.5e0) + -0.25e0 * (r + 0.5e0) + 13e0 AS lat FROM grid WHERE lost = 1), h AS (SELECT r, c, min(cod) AS cod FROM px, poly WHERE ({CROSSINGS}) % 2 = 1 GROUP BY ALL) SELECT cod, floor(count(*) * 0.01 * 100 + 0.5) / 100 AS ha_perdida FROM h GROUP BY cod",
    "raster_patches": _w(GRID) + ', t AS (SELECT (i * 8)::INT AS top, (j * 8)::INT AS "left", count(*) / 256.0::DOUBLE AS share FROM grid, range(7) a(i), range(7) b(j) WHERE nir > 3600 AND r BETWEEN i * 8 AND i * 8 + 15 AND c BETWEEN j * 8 AND j * 8 + 15 GROUP BY ALL) SELECT top, "left", floor(share * 1e6 + 0.5) / 1e6 AS valid_share FROM t WHERE share >= 0.6',
    "land_cover_resampled": _w(GRID) + ", t AS (SELECT r.i::INT AS row, c.j::INT AS col, 0.1e0 * (j + 0.5e0) + 0e0 * (i + 0.5e0) + -79.03e0 - -79e0 AS dx, 0e0 * (j + 0.5e0) + -0.1e0 * (i + 0.5e0) + 13.04e0 - 13e0 AS dy FROM range(100) r(i), range(130) c(j)), u AS (SELECT row, col, floor((dx * -0.25e0 - dy * 0e0) / -0.05e0)::BIGINT AS sc, floor((dy * 0.2e0 - dx * 0e0) / -0.05e0)::BIGINT AS sr FROM t) SELECT row, col, (nir::BIGINT % 3 * 10 = 10)::INT AS forest FROM u LEFT JOIN grid ON r = sr AND c = sc",
    "reflectance": _w(PIXELS) + ", s AS (SELECT zone, floor(least(greatest(nir0 * 2 / 10000e0, 0), 1) * 1e4 + 0.5) / 1e4 AS v FROM nd) SELECT zone, max(v) AS most, min(v) AS least FROM s GROUP BY zone",
    "csv_text": "SELECT CASE WHEN length(c_custkey::VARCHAR) >= 5 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS cod, c_name || ', \"' || c_mktsegment || '\"' AS name, NULL::VARCHAR AS other FROM customer",
    "csv_typed": "SELECT s_suppkey, s_acctbal FROM supplier",
    "csv_optional": "SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS cod, 0::DOUBLE AS focos FROM nation",
    "paged_rows": NATIONS,
    "paged_features": NATIONS,
    "json_table": NATIONS,
    "workbook": NATIONS,
    "hotspot_products": _w(HOT) + " SELECT sensor, acq_date, count(*) AS focos, sum(frp::DECIMAL(18,4))::DOUBLE AS frp_total FROM hot WHERE sensor IN ('click', 'view') AND lon BETWEEN -78 AND -68 AND lat BETWEEN -3 AND 12 GROUP BY ALL",
    "geojson_polygons": _w(HOT, POLY) + f", h AS (SELECT event_id, min(cod) AS cod FROM (SELECT event_id, poly.cod AS cod FROM hot, poly WHERE ({CROSSINGS}) % 2 = 1) GROUP BY 1) SELECT h.cod::BIGINT AS cod, n_name AS mpio, count(*) AS focos FROM h JOIN nation ON n_nationkey = h.cod GROUP BY ALL",
    "scene_search": _w(POLY, "f AS (SELECT printf('scene-%02d-%d', n_nationkey, n_regionkey) AS item, n_regionkey::VARCHAR AS region, x, y, (n_nationkey * 7 % 40)::DOUBLE AS cloud, strftime(DATE '2024-01-01' + (n_nationkey * 11 % 60)::INT, '%Y-%m-%d') AS date FROM poly JOIN nation ON n_nationkey = cod)", "k AS (SELECT * FROM f WHERE x + 0.5 >= -78 AND x - 0.5 <= -68 AND y + 0.5 >= -3 AND y - 0.5 <= 12 AND date BETWEEN '2024-01-01' AND '2024-02-15' AND cloud < 30)") + " SELECT region, arg_min(item, struct_pack(cloud, item)) AS item, arg_min(date, struct_pack(cloud, item)) AS date, min(cloud) AS cloud FROM k GROUP BY region",
    "raster_window": "SELECT r::INT AS row, c::INT AS col, coalesce(max(l_suppkey % 200), 0) AS value FROM range(20, 60) a(r), range(30, 55) b(c) LEFT JOIN lineitem ON l_orderkey % 90 = r AND l_partkey % 70 = c GROUP BY ALL",
    "json_summary": "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders",
    "text_documents": "SELECT 'doc' || r_regionkey || '-' || i AS id, CASE i WHEN 0 THEN '# ' || r_name || chr(10) || chr(10) || 'intro ' || r_regionkey WHEN 1 THEN 'First' || chr(10) || chr(10) || 'one' ELSE 'Second' || chr(10) || 'two' END AS texto FROM region, range(3) t(i)",
    "vector_index": "SELECT vec_id, label, floor(sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * 1e4 + 0.5) / 1e4 AS length FROM embeddings",
    "saved_model": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS said FROM part",
    "console_report": "SELECT 0::INT AS line, 'Regions' AS text UNION ALL SELECT 1, 'r_regionkey  r_name' UNION ALL SELECT (1 + row_number() OVER (ORDER BY r_regionkey))::INT, rpad(r_regionkey::VARCHAR, 11, ' ') || '  ' || r_name FROM region",
    "html_report": "SELECT i::INT AS line, t AS text FROM (SELECT unnest(range(5)) AS i, unnest(['<!doctype html><meta charset=utf-8><title>Regions</title><h1>Regions</h1>', '<h2>Note</h2>', '<p>a &lt; b &amp; c</p>', '<h2>Table</h2>', (SELECT '<table><tr><th>r_regionkey</th><th>r_name</th></tr>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</table>' FROM region)]) AS t)",
    "missing_outputs": "SELECT 'gone' AS name",
    "missing_columns": "SELECT unnest(['n_code', 'n_area']) AS name",
    "segmented_tiles": "SELECT (r // 16)::INT AS i, (c // 16)::INT AS j, count(*)::INT AS pixels, sum((v > 48.5)::INT)::INT AS lit FROM (SELECT (l_orderkey % 64)::INT AS r, (l_partkey % 64)::INT AS c, max(l_suppkey % 97) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL",
    "territory_master": _w(MASTER) + " SELECT * FROM master",
    "code_conformance": """SELECT c_custkey, CASE WHEN length(trim(raw_)) >= 5 THEN trim(raw_) ELSE lpad(trim(raw_), 5, '0') END AS cod, CASE WHEN isnan(v) THEN NULL ELSE v END AS num, coalesce(CASE WHEN isnan(v) THEN NULL ELSE v END, 0) AS num0
  FROM (SELECT *, try_cast(replace(trim(txt), ',', '.') AS DOUBLE) AS v FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN '9' || lpad(c_custkey::VARCHAR, 6, '0') WHEN 2 THEN '' ELSE c_custkey::VARCHAR END AS raw_,
  CASE c_custkey % 5 WHEN 0 THEN (c_custkey % 97)::VARCHAR || ',5' WHEN 1 THEN '1,234.5' WHEN 2 THEN 'nan' WHEN 3 THEN 'x' ELSE NULL END AS txt FROM customer))""",
    "name_normalise_join": """SELECT n.n_nationkey AS cod, max(o_totalprice) AS worst FROM (SELECT upper(n_name) AS k, max(n_nationkey) AS n_nationkey FROM nation GROUP BY 1) n
  JOIN (SELECT trim(regexp_replace(upper(raw_), '\\s+', ' ', 'g')) AS k, o_totalprice FROM (SELECT '  ' || lower(n_name) || '  ' AS raw_, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)) o USING (k)
  WHERE o_totalprice > 0 GROUP BY 1""",
    "nearest_centroid": _w(POLY, f"s AS (SELECT s_suppkey, ((s_suppkey * 7919) % 1700)::DOUBLE / 100 - 4 AS lat, ((s_suppkey * 104729) % 1200)::DOUBLE / 100 - 79 AS lon FROM supplier), r AS (SELECT s_suppkey, cod, {KM} AS km FROM s, poly), t AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, cod) AS k FROM r)") + " SELECT s_suppkey, cod, floor(km * 1e4 + 0.5) / 1e4 AS km FROM t WHERE k = 1 AND km < 300",
    "nearest_radius_sum": _w(POLY, f"s AS (SELECT p_partkey, p_retailprice, ((p_partkey * 7919) % 1700)::DOUBLE / 100 - 4 AS lat, ((p_partkey * 104729) % 1200)::DOUBLE / 100 - 79 AS lon FROM part), r AS (SELECT p_partkey, p_retailprice, cod, {KM} AS km FROM s, poly), t AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY km, cod) AS k FROM r)") + " SELECT cod, count(*) AS areas, sum(p_retailprice::DECIMAL(18,4))::DOUBLE AS hectareas FROM t WHERE k = 1 AND km < 60 GROUP BY cod",
    "bbox_filter": _w(HOT) + " SELECT event_id, lat, lon FROM hot WHERE lon BETWEEN -75 AND -70.5 AND lat BETWEEN 0 AND 5.25",
    "point_in_polygon": _w(HOT, POLY) + f", h AS (SELECT event_id, min(cod) AS cod FROM (SELECT event_id, poly.cod AS cod FROM hot, poly WHERE ({CROSSINGS}) % 2 = 1) GROUP BY 1) SELECT hot.event_id, h.cod FROM hot LEFT JOIN h USING (event_id)",
    "area_of_interest": _w(POLY) + " SELECT min(x) - 2.0 AS lon_min, min(y) - 2.0 AS lat_min, max(x) + 2.0 AS lon_max, max(y) + 2.0 AS lat_max FROM poly WHERE cod IN (1, 3, 5)",
    "hotspot_aggregate": _w(HOT) + " SELECT cod_mpio, focos_7d, frp_total, ultima_fecha, floor(least(1.0, ln(1 + frp_total) / coalesce(nullif((SELECT ln(1 + max(frp_total)) FROM fire), 0), 1)) * 1e4 + 0.5) / 1e4 AS idx_fuego FROM fire",
    "hotspot_stream": "SELECT event_type AS sensor, ts::DATE AS day, count(*) AS focos, sum(value::DECIMAL(18,4))::DOUBLE AS frp_total FROM events GROUP BY ALL",
    "index_logminmax": _w(LABELLED) + " SELECT cod_mpio, idx_minero, idx_deforestacion, idx_fuego, idx_hidrico, idx_sensibilidad FROM labelled",
    "risk_score_level": _w(LABELLED) + " SELECT * FROM labelled",
    "level_distribution": _w(LABELLED) + " SELECT riesgo_nivel, count(*) AS n FROM labelled GROUP BY 1",
    "level_monotonicity": _w(LABELLED) + ", g AS (SELECT riesgo_nivel, min(riesgo_score) AS lo, max(riesgo_score) AS hi FROM labelled GROUP BY 1) SELECT *, lag(hi) OVER (ORDER BY list_position(['Bajo', 'Medio', 'Alto', 'Crítico'], riesgo_nivel)) AS previous_hi, coalesce((previous_hi >= lo)::INT, 0) AS overlaps FROM g",
    "signal_coverage": _w(LABELLED, "c AS (SELECT count(*) AS t, count(CASE WHEN mineria_titulos > 0 THEN 1 END) AS a, count(CASE WHEN deforestacion_ha > 0 THEN 1 END) AS b, count(CASE WHEN agua_estaciones > 0 THEN 1 END) AS c, count(CASE WHEN runap_areas > 0 THEN 1 END) AS d, count(CASE WHEN es_pdet > 0 THEN 1 END) AS e FROM labelled), u AS (SELECT t, unnest(['mining', 'forest', 'water', 'protected', 'pdet']) AS signal, unnest([a, b, c, d, e]) AS n FROM c)") + " SELECT signal, n, floor(n * 100 * 100 / greatest(t, 1) + 0.5) / 100 AS percent FROM u",
    "signals_per_territory": _w(LABELLED) + " SELECT (mineria_titulos > 0)::INT + (deforestacion_ha > 0)::INT + (agua_estaciones > 0)::INT + (runap_areas > 0)::INT AS signals, count(*) AS n FROM labelled GROUP BY 1",
    "top10_score": _w(LABELLED) + " SELECT cod_mpio, municipio, riesgo_score, riesgo_nivel FROM labelled ORDER BY riesgo_score DESC, cod_mpio LIMIT 10",
    "top15_score": _w(LABELLED) + " SELECT cod_mpio, municipio, riesgo_score FROM labelled ORDER BY riesgo_score DESC, cod_mpio LIMIT 15",
    "top_frp": _w(HOT) + " SELECT cod_mpio, focos_7d, frp_total FROM fire ORDER BY frp_total DESC, cod_mpio LIMIT 10",
    "top6_max_priority": _w(LABELLED) + " SELECT cod_mpio, frp_total FROM labelled WHERE riesgo_nivel IN ('Alto', 'Crítico') AND focos_7d > 0 ORDER BY frp_total DESC, cod_mpio LIMIT 6",
    "top6_per_department": _w(LABELLED) + ", r AS (SELECT departamento, cod_mpio, riesgo_score, row_number() OVER (PARTITION BY departamento ORDER BY riesgo_score DESC, cod_mpio)::INT AS place FROM labelled) SELECT * FROM r WHERE place <= 6",
    "department_rollup": _w(LABELLED, "r AS (SELECT departamento, cod_mpio, row_number() OVER (PARTITION BY departamento ORDER BY riesgo_score DESC, cod_mpio) AS k FROM labelled WHERE riesgo_nivel IN ('Alto', 'Crítico')), l AS (SELECT departamento, string_agg(cod_mpio, ', ' ORDER BY k) AS leaders FROM r WHERE k <= 6 GROUP BY 1), g AS (SELECT departamento, count(*) AS total, sum((riesgo_nivel IN ('Alto', 'Crítico'))::INT)::BIGINT AS high, sum(focos_7d)::BIGINT AS events FROM labelled GROUP BY 1)") + " SELECT g.*, coalesce(leaders, '') AS leaders FROM g LEFT JOIN l USING (departamento) WHERE high > 0 OR events > 0",
    "priority_cross": _w(LABELLED) + " SELECT sum(focos_7d)::BIGINT AS focos, count(CASE WHEN focos_7d > 0 THEN 1 END) AS con_fuego, count(CASE WHEN focos_7d > 0 AND riesgo_nivel IN ('Alto', 'Crítico') THEN 1 END) AS maxima_prioridad, count(CASE WHEN frp_total > 200 AND riesgo_nivel IN ('Bajo', 'Medio') THEN 1 END) AS actividad_nueva FROM labelled",
    "fire_high_intersect": _w(LABELLED) + " SELECT cod_mpio FROM labelled WHERE focos_7d > 0 INTERSECT SELECT cod_mpio FROM labelled WHERE riesgo_nivel IN ('Alto', 'Crítico')",
    "fire_high_difference": _w(LABELLED) + " SELECT cod_mpio FROM labelled WHERE frp_total > 200 EXCEPT SELECT cod_mpio FROM labelled WHERE riesgo_nivel IN ('Alto', 'Crítico')",
    "choropleth_values": _w(HOT) + " SELECT n_nationkey AS cod, n_name AS mpio, coalesce(c, 0) AS focos FROM nation LEFT JOIN (SELECT event_id % 31 AS k, count(*) AS c FROM hot GROUP BY 1) ON n_nationkey = k",
    "dominant_factor": _w(LABELLED, "d AS (SELECT *, greatest(idx_minero, idx_deforestacion, idx_fuego, idx_hidrico, idx_sensibilidad) AS g FROM labelled)") + f" SELECT {DOM} AS dominante, count(*) AS n FROM d GROUP BY 1",
    "view_filter": _w(LABELLED) + " SELECT count(*) AS n, max(riesgo_score) AS top FROM labelled WHERE departamento IN (1, 2, 3) AND riesgo_nivel IN ('Medio', 'Alto')",
    "display_clip": _w(LABELLED, "c AS (SELECT quantile_cont(frp_total, 0.97) AS p FROM labelled WHERE frp_total > 0)") + " SELECT cod_mpio, floor(least(frp_total, p) * 1e4 + 0.5) / 1e4 AS frp_clip FROM labelled, c",
    "name_override": "SELECT s_suppkey, coalesce(c_name, s_name) AS name FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND c_custkey % 2 = 0",
    "sensor_union": " UNION ALL ".join(f"SELECT '{t}' AS sensor, event_id, value AS frp FROM events WHERE event_type = '{t}'" for t in ("click", "view", "purchase")),
    "duplicate_keys": "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 1",
    "confusion_matrix": _w(PRED) + " SELECT y, count(CASE WHEN yhat = 0 THEN 1 END) AS pred_0, count(CASE WHEN yhat = 1 THEN 1 END) AS pred_1 FROM pred GROUP BY y",
    "class_metrics": _w(PRED, "k AS (SELECT DISTINCT y AS label FROM pred UNION SELECT DISTINCT yhat FROM pred)", "m AS (SELECT label, count(CASE WHEN y = label AND yhat = label THEN 1 END)::DOUBLE AS h, count(CASE WHEN y = label THEN 1 END) AS s, count(CASE WHEN yhat = label THEN 1 END) AS q FROM pred, k GROUP BY label)", "r AS (SELECT label, CASE WHEN q > 0 THEN h / q ELSE 0 END AS p, CASE WHEN s > 0 THEN h / s ELSE 0 END AS c, s FROM m)") + " SELECT label, floor(p * 1e6 + 0.5) / 1e6 AS precision, floor(c * 1e6 + 0.5) / 1e6 AS recall, floor(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END * 1e6 + 0.5) / 1e6 AS f1, s AS support FROM r",
    "majority_baseline": _w(PRED, "c AS (SELECT y, count(*) AS c FROM pred GROUP BY y)", "m AS (SELECT y, c FROM c ORDER BY c DESC, y LIMIT 1)") + " SELECT floor(avg((p.y = yhat)::INT) * 1e6 + 0.5) / 1e6 AS accuracy, floor(max(c)::DOUBLE / count(*) * 1e6 + 0.5) / 1e6 AS baseline, max(m.y) AS majority, count(*) AS n FROM pred p, m",
    "conformal_qhat": _w(PROBA, "s AS (SELECT 1 - p[y + 1] AS s FROM proba)") + f" SELECT floor(qhat * 1e6 + 0.5) / 1e6 AS qhat, n_cal FROM ({_qhat('s')})",
    "conformal_sets": _w(PROBA, "s AS (SELECT 1 - p[y + 1] AS s FROM proba)", f"q AS ({_qhat('s')})", "t AS (SELECT doc_id, p, list_filter(range(4), lambda i: p[i + 1] >= 1 - qhat) AS m0 FROM proba, q)", "u AS (SELECT doc_id, CASE WHEN len(m0) = 0 THEN [list_position(p, list_max(p)) - 1] ELSE m0 END AS m FROM t)") + " SELECT doc_id, array_to_string(list_transform(m, lambda i: ['Bajo', 'Medio', 'Alto', 'Crítico'][i + 1]), ' / ') AS conjunto_conformal, len(m)::INT AS tamano_conjunto, CASE len(m) WHEN 1 THEN 'Alta' WHEN 2 THEN 'Media' ELSE 'Baja' END AS certeza_calibrada FROM u",
    "linear_shapley": _w(LABELLED, "m AS (SELECT " + ", ".join(f"avg({c}::DECIMAL(18,6)) AS m_{c}" for c in ("idx_minero", "idx_deforestacion", "idx_fuego", "idx_hidrico", "idx_sensibilidad")) + " FROM labelled)") + " SELECT cod_mpio, " + ", ".join(f"floor({w}::DOUBLE * ({c} - m_{c}) * 1e5 + 0.5) / 1e5 AS phi_{c}" for c, w in (("idx_minero", "0.3"), ("idx_deforestacion", "0.25"), ("idx_fuego", "0.15"), ("idx_hidrico", "0.2"), ("idx_sensibilidad", "0.1"))) + " FROM labelled, m",
    "stratified_split": "SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919) % 10007, doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.25 + 0.5))::INT AS is_test FROM labels",
    "cosine_topk": _w("q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)", "s AS (SELECT vec_id, label, floor(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE)) / ((sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) + 1e-9) * (sqrt(list_dot_product(list_transform(e, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE))) + 1e-9)) * 1e4 + 0.5) / 1e4 AS score FROM embeddings, q)") + " SELECT vec_id, label, score FROM s ORDER BY score DESC, vec_id LIMIT 6",
    "vector_norms": "SELECT vec_id, floor(sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * 1e4 + 0.5) / 1e4 AS length FROM embeddings",
    "ndvi_loss_zonal": _w(PIXELS) + ", z AS (SELECT zone, sum(CASE WHEN v0 > 0.6 AND v0 - v1 > 0.15 THEN 1 ELSE 0 END) AS n FROM nd GROUP BY zone HAVING n > 0) SELECT zone, floor(n * 0.01 * 100 + 0.5) / 100 AS ha_perdida FROM z",
    "raster_crop": _w(PIXELS) + ", a AS (SELECT row_, col_, max(v0) AS v0 FROM nd WHERE row_ < 40 GROUP BY ALL), b AS (SELECT row_, col_, max(v1) AS v1 FROM nd WHERE col_ < 48 GROUP BY ALL) SELECT count(*) AS pixels, sum((v0 > 0.6 AND v0 - v1 > 0.15)::INT)::BIGINT AS lost FROM a JOIN b USING (row_, col_)",
    "raster_tiles": _w(PIXELS) + ", t AS (SELECT (row_ // 16)::INT AS tile_row, (col_ // 16)::INT AS tile_col, count(*) AS pixels, sum((nir0 > 3600)::INT) AS ok FROM nd GROUP BY ALL) SELECT tile_row, tile_col, pixels, floor(ok::DOUBLE / pixels * 1e6 + 0.5) / 1e6 AS valid_share FROM t WHERE ok >= 0.6 * pixels",
    "mask_iou": _w(PIXELS) + ", m AS (SELECT count(CASE WHEN v0 > 0.5 AND v1 > 0.5 THEN 1 END) AS intersection, count(CASE WHEN v0 > 0.5 OR v1 > 0.5 THEN 1 END) AS union_ FROM nd) SELECT intersection, union_, floor(CASE WHEN union_ > 0 THEN intersection::DOUBLE / union_ ELSE 0 END * 1e6 + 0.5) / 1e6 AS iou FROM m",
    "mask_difference": _w(PIXELS) + " SELECT zone, sum((v0 > 0.5 AND v1 <= 0.5)::INT)::BIGINT AS lost FROM nd GROUP BY zone",
    "quality_violations": _w(LABELLED) + " SELECT count(*) - count(DISTINCT cod_mpio) AS repeated_keys, count(CASE WHEN NOT (lat BETWEEN -4.5 AND 13.5 AND lon BETWEEN -82 AND -66) THEN 1 END) AS outside, count(CASE WHEN NOT (idx_minero BETWEEN 0 AND 1 AND idx_deforestacion BETWEEN 0 AND 1 AND idx_fuego BETWEEN 0 AND 1 AND idx_hidrico BETWEEN 0 AND 1 AND idx_sensibilidad BETWEEN 0 AND 1 AND riesgo_score BETWEEN 0 AND 1) THEN 1 END) AS out_of_range, count(CASE WHEN agua_estaciones = 0 AND idx_hidrico <> 0 THEN 1 END) AS water_without_sample, count(CASE WHEN riesgo_nivel NOT IN ('Bajo', 'Medio', 'Alto', 'Crítico') THEN 1 END) AS unknown_level, count(DISTINCT riesgo_nivel) AS levels FROM labelled",
    "hotspot_windows": _w(HOT) + ", d AS (SELECT event_id, sensor, frp, acq_date, unnest(range(7)) AS k FROM hot) SELECT sensor, (acq_date - k::INT) AS first_day, count(*) AS focos, sum(frp::DECIMAL(18,4))::DOUBLE AS frp_total FROM d GROUP BY ALL",
}
