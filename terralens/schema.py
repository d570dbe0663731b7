"""Column types of the input tables, as DDL.

Fixed values: column names, levels, indices, weights, features and the box are those of
the domain's own tables and published method.
"""

TERRITORY = "cod_mpio string, nom_mpio string, dpto string, latitud string, longitud string"
MINING_REGISTRY = "codigo_dane string, municipio string, departamento string, mineral string, nombre_persona string"
MINING_VOLUME = "codigo_dane string, volumenes_de_explotacion string, regalias_pagadas string, recurso_natural string"
PDET = "nom_subreg string, nom_depto string, cod_depto string, cod_subreg string, cod_muni string, nom_muni string"
FOREST_LOSS = "No_Bosque string, `Año` string, Defores string, Bosque string, MPIO_NAREA string, DPTO_CNMBR string, MPIO_CNMBR string"
WATER = "categoria string, lat string, ica6 string, ica5 string, areaoperativa string, clase string, fechamuestra string, lon string, nombre string, estacionid string"
PROTECTED = "nombre string, categoria string, hectareas_ string, `Área_Oficial__Ha_` string, `Area_Oficial__Ha_` string, centroid_x string, centroid_y string, organizaci string"
HOTSPOT = "latitude string, longitude string, acq_date string, frp string, confidence string, daynight string"
FIRE = "cod_mpio string, municipio string, departamento string, focos_7d string, frp_total string, idx_fuego string, ultima_fecha string"

LEVELS = ("Bajo", "Medio", "Alto", "Crítico")
INDICES = ("idx_minero", "idx_deforestacion", "idx_fuego", "idx_hidrico", "idx_sensibilidad")
WEIGHTS = {"idx_minero": 0.30, "idx_deforestacion": 0.25, "idx_fuego": 0.15, "idx_hidrico": 0.20, "idx_sensibilidad": 0.10}
FEATURES = (
    *INDICES, "mineria_titulos", "mineria_minerales", "deforestacion_ha", "runap_areas", "runap_hectareas", "agua_estaciones",
    "mineria_volumen", "mineria_regalias", "es_pdet", "focos_7d",
)
#: lon_min, lat_min, lon_max, lat_max
BBOX = (-79.2, -4.4, -66.7, 13.6)
