"""Queries on cleaning, counting, normalising, indices, exploring, periods, outliers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.operators import cleaning, explore, facts, filters, indices, names, normalise, outliers, temporal
from terrane.plans import fixtures as X
from terrane.plans.fixtures import THREE

#: Shared table expressions of the SQL side.
RECORDS = "records AS (SELECT l_suppkey AS cell, l_partkey AS species_id, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS quantity, l_discount AS discount FROM lineitem)"
DIM = 'dim AS (SELECT p_partkey AS species_id, p_type AS kingdom, p_brand AS class, p_size AS "order", p_name AS species FROM part)'
FACTS = f"{RECORDS}, facts AS (SELECT cell, species_id, count(*) AS n_obs FROM records GROUP BY ALL)"
NAMED = f'{FACTS}, {DIM}, named AS (SELECT facts.*, kingdom, class, "order", species FROM facts JOIN dim USING (species_id))'
PERIOD = "CASE WHEN year > 1994 AND year <= 1996 THEN 'Période 1: 1995 à 1996' WHEN year > 1996 AND year <= 1998 THEN 'Période 2: 1997 à 1998' WHEN year > 1998 AND year <= 2001 THEN 'Période 3: 1999 à 2001' END"
PERIODS = f"{RECORDS}, periods AS (SELECT cell, species_id, {PERIOD} AS period, count(*) AS n_obs FROM records WHERE {PERIOD} IS NOT NULL GROUP BY ALL)"
SUMMED = f"{FACTS}, totals AS (SELECT cell, CAST(sum(n_obs) AS DOUBLE) AS s FROM facts GROUP BY cell)"


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _protected(s, d):
    rows = X.records(s, d, F.when(F.col("l_discount") > 0.05, "True").otherwise("False").alias("especeProtegee")).withColumn("n_obs", F.lit(1))
    return explore.protected_species(rows, list(range(1, 21)))


def _scalars(s, d):
    p = X.table(s, d, "part")
    name = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise(F.lit("x")))
    code = F.when(F.col("p_size") % 4 == 0, F.lit("2A | 2B")).when(F.col("p_size") % 4 == 1, F.lit("2B | 13")).when(F.col("p_size") % 4 == 2, F.concat(F.lit("01 | "), (F.col("p_size") * 30).cast("string"))).otherwise(F.lit(""))
    return p.select("p_partkey", C.clean_scientific_name(name).alias("clean"), C.department_codes(code).alias("codes"), C.round_to_significant("p_retailprice", 3, "nearest").alias("sig"), C.round_to_significant("p_retailprice", 2, "up").alias("sig_up"), C.round_to_significant("p_retailprice", 2, "down").alias("sig_down"), C.clamped("p_retailprice", 950, 1200).alias("clamped"), C.first_part(F.concat(F.lit(" a"), F.col("p_size").cast("string"), F.lit(" | b")), "|").alias("part"), C.title_case(F.concat(F.col("p_name"), F.lit("-o'hara"))).alias("title"), C.number(F.col("p_size").cast("string")).alias("num"), C.integer(F.lit("5.7")).alias("whole"))


SCALARS = """
SELECT p_partkey,
  CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) || ' ' || p_brand ELSE split_part(p_name, ' ', 1) || ' ' || p_brand || ' x' END AS clean,
  CASE p_size % 4 WHEN 0 THEN '2A, 2B' WHEN 1 THEN '2B' WHEN 2 THEN CASE WHEN p_size * 30 <= 900 THEN '01, ' || CAST(p_size * 30 AS VARCHAR) ELSE '01' END ELSE '' END AS codes,
  round_even(p_retailprice * f3, 0) / f3 AS sig, ceil(p_retailprice * f2) / f2 AS sig_up, floor(p_retailprice * f2) / f2 AS sig_down,
  CAST(CASE WHEN p_retailprice < 950 THEN 950 WHEN p_retailprice > 1200 THEN 1200 ELSE p_retailprice END AS DOUBLE) AS clamped,
  'a' || CAST(p_size AS VARCHAR) AS part,
  array_to_string(list_transform(string_split(lower(p_name || '-o''hara'), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda v: array_to_string(list_transform(string_split(v, ''''), lambda u: upper(u[1:1]) || u[2:]), '''')), '-')), ' ') AS title,
  CAST(p_size AS DOUBLE) AS num, CAST(5 AS BIGINT) AS whole
FROM (SELECT *, pow(10.0, 2 - floor(log10(p_retailprice))) AS f3, pow(10.0, 1 - floor(log10(p_retailprice))) AS f2 FROM part)
"""


def _inventory(s, d):
    p = X.table(s, d, "part").withColumn("row", F.col("p_partkey"))
    raw = p.select(F.col("p_partkey").cast("string").alias("cdRef"), F.when(F.col("p_size") % 5 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name")).alias("nomScientifiqueRef"), F.concat_ws(" | ", F.col("p_brand"), F.lit("z")).alias("codeMaille10Km"), F.lit("75").alias("codeInseeDepartement"), F.lit("2020-03-01").alias("dateObservation"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("classe"))
    out = cleaning.clean_inventory(raw, "reptiles")
    return out.select("cdRef", "nomScientifique", "codeMaille10Km", "codeDepartement", "classe", "all", "year", "month", "day", "day_of_year")


def _coerced(s, d):
    li = X.table(s, d, "lineitem")
    raw = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "x").otherwise(F.col("l_quantity").cast("string")).alias("decimalLongitude"), F.col("l_tax").cast("string").alias("decimalLatitude"), F.col("l_partkey").cast("string").alias("speciesKey"), F.when(F.col("l_returnflag") == "A", F.lit("abc")).otherwise(F.year("l_shipdate").cast("string")).alias("year"), F.date_format("l_shipdate", "yyyyMMdd").alias("eventDate"), F.when(F.col("l_linestatus") == "O", F.lit("3")).alias("individualCount"), F.when(F.col("l_discount") > 0.02, "PRESENT").otherwise("ABSENT").alias("occurrenceStatus"))
    out = cleaning.within_box(cleaning.present_only(cleaning.coerce_occurrences(raw)), 5, 40, 0, 0.06)
    return out.select("l_orderkey", "l_linenumber", "decimalLongitude", "decimalLatitude", "speciesKey", "year", "individualCount")


def _flagged(s, d):
    rows = X.facts(s, d).withColumn("flag", (F.col("cell") % 10) == 0)
    return outliers.replace_flagged(rows, "flag").select("cell", "species_id", "n_obs")


def _put_back(s, d):
    rows = X.facts(s, d)
    fixed = outliers.winsorised(rows.filter("cell % 2 = 0")).select("cell", "species_id", F.col("n_obs_corrected").alias("n_obs"))
    return outliers.put_back(rows, fixed, ["cell", "species_id"])


def _streamed(s, d):
    """The stream's table of counts; the batch count of the same rows is its SQL."""
    import uuid

    from terrane.operators.stored import folder
    from terrane.streaming.counts import keep_table, kept_table, occurrence_stream, parts_for, streamed_counts

    where = f"{folder(s)}/stream-{uuid.uuid4().hex}"
    records = X.records(s, d)
    n = records.count()
    files = parts_for(n, 4)
    records.repartition(files).write.parquet(f"{where}/in")
    rows = occurrence_stream(s, f"{where}/in", s.read.parquet(f"{where}/in").schema, per_batch=-(-files // 2))
    counts = streamed_counts(rows, THREE)
    parts = parts_for(n, int(s.conf.get("spark.sql.shuffle.partitions")))
    name = "spark.sql.files.maxPartitionBytes"
    read = s.conf.get(name)
    s.conf.set(name, "4m")  # a file a task
    try:
        keep_table(counts, f"{where}/out", f"{where}/state", ["cell", "species_id", "period"], buckets=parts_for(n, 16), parts=parts).awaitTermination()
    finally:
        s.conf.set(name, read)
    return kept_table(s, f"{where}/out", counts.schema)


_SHARE = "round({v} / sum({v}) OVER (PARTITION BY {k}) * {t}, 6)"
_MEAN = "(SELECT avg(t) FROM (SELECT sum({v}) AS t FROM {f} GROUP BY {k}))"


def _share(v: str, k: str, f: str) -> str:
    return _SHARE.format(v=v, k=k, t=_MEAN.format(v=v, f=f, k=k))


QUERIES = {
    "count_cells": (lambda s, d: facts.count_cells(X.observations(s, d), bounds=THREE).select("cell", "species_id", "period", "n_obs", "kingdom", "class", "order", "species"), f'WITH {PERIODS}, {DIM} SELECT cell, species_id, period, n_obs, kingdom, class, "order", species FROM periods JOIN dim USING (species_id)'),
    "count_cells_since": (lambda s, d: facts.count_cells(X.records(s, d), first_year=1998, with_taxonomy=False), f"WITH {RECORDS} SELECT cell, species_id, count(*) AS n_obs FROM records WHERE year >= 1998 GROUP BY ALL"),
    "streamed_counts": (_streamed, f"WITH {PERIODS} SELECT cell, species_id, period, n_obs FROM periods"),
    "period_histogram": (lambda s, d: facts.period_histogram(X.records(s, d), THREE), f"WITH {PERIODS} SELECT period, CAST(sum(n_obs) AS BIGINT) AS n FROM periods GROUP BY period"),
    "year_histogram": (lambda s, d: facts.year_histogram(X.records(s, d), 1995, 2001, 3), f"WITH {RECORDS} SELECT CAST(least(floor((year - 1995) / 2.0) + 1, 3) AS BIGINT) AS bin, count(*) AS n FROM records WHERE year BETWEEN 1995 AND 2001 GROUP BY ALL"),
    "merge_counts": (lambda s, d: facts.merge_counts([facts.count_cells(X.records(s, d).filter(f"cell % 3 = {k}"), bounds=THREE, with_taxonomy=False) for k in range(3)], ["cell", "species_id", "period"]), f"WITH {PERIODS} SELECT cell, species_id, period, n_obs FROM periods"),
    "without_period": (lambda s, d: facts.without_period(X.facts_by_period(s, d), X.dimension(s, d)), f'WITH {PERIODS}, {DIM} SELECT cell, species_id, CAST(sum(n_obs) AS BIGINT) AS n_obs, kingdom, class, "order", species FROM periods LEFT JOIN dim USING (species_id) GROUP BY ALL'),
    "taxonomy": (lambda s, d: facts.taxonomy(X.observations(s, d).withColumn("class", F.when(F.col("cell") % 2 == 0, F.col("class"))), columns=["kingdom", "class", "species"]), f'WITH {RECORDS}, {DIM}, o AS (SELECT species_id, kingdom, CASE WHEN cell % 2 = 0 THEN class END AS class, species FROM records JOIN dim USING (species_id)) SELECT species_id, kingdom, class, species FROM (SELECT *, row_number() OVER (PARTITION BY species_id ORDER BY class IS NULL, kingdom, class, species) AS r FROM o) WHERE r = 1'),
    "completed_all": (lambda s, d: facts.completed(X.facts(s, d), X.facts(s, d)), f"WITH {FACTS} SELECT c.cell, k.species_id, coalesce(f.n_obs, 0) AS n_obs FROM (SELECT DISTINCT cell FROM facts) c CROSS JOIN (SELECT DISTINCT species_id FROM facts) k LEFT JOIN facts f ON f.cell = c.cell AND f.species_id = k.species_id"),
    "first_by": (lambda s, d: facts.first_by(X.facts(s, d), ["cell"], [F.desc("n_obs"), F.col("species_id")]), f"WITH {FACTS} SELECT cell, species_id, n_obs FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n_obs DESC, species_id) AS r FROM facts) WHERE r = 1"),
    "duplicates": (lambda s, d: facts.duplicates(X.records(s, d), ["cell", "species_id", "year"]), f"WITH {RECORDS} SELECT cell, species_id, year, count(*) AS n FROM records GROUP BY ALL HAVING count(*) > 1"),
    "periods_of": (lambda s, d: facts.periods_of(X.facts_by_period(s, d)).select("cell", "species_id", F.concat_ws("; ", "periods").alias("periods")), f"WITH {PERIODS} SELECT cell, species_id, string_agg(period, '; ' ORDER BY period) AS periods FROM periods GROUP BY ALL"),
    "scalar_functions": (_scalars, SCALARS),
    "clean_inventory": (_inventory, "SELECT CAST(p_partkey AS VARCHAR) AS cdRef, p_name AS nomScientifique, p_brand AS codeMaille10Km, '75' AS codeDepartement, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'Reptilia' END AS classe, 'All' AS \"all\", CAST(2020 AS INTEGER) AS year, CAST(3 AS INTEGER) AS month, CAST(1 AS INTEGER) AS day, CAST(61 AS INTEGER) AS day_of_year FROM part WHERE p_size % 5 <> 0 AND p_name LIKE '% %'"),
    "coerce_occurrences": (_coerced, "SELECT l_orderkey, l_linenumber, l_quantity AS decimalLongitude, l_tax AS decimalLatitude, l_partkey AS speciesKey, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(CASE WHEN l_linestatus = 'O' THEN 3 ELSE 1 END AS DOUBLE) AS individualCount FROM lineitem WHERE l_linenumber <> 1 AND l_discount > 0.02 AND l_quantity BETWEEN 5 AND 40 AND l_tax BETWEEN 0 AND 0.06"),
    "null_counts": (lambda s, d: cleaning.null_counts(X.observations(s, d).select("cell", F.when(F.col("cell") % 2 == 0, F.col("species")).alias("species"))), f"WITH {RECORDS} SELECT CAST(count(*) FILTER (WHERE cell IS NULL) AS BIGINT) AS cell, CAST(count(*) FILTER (WHERE cell % 2 <> 0) AS BIGINT) AS species FROM records"),
    "loss_report": (lambda s, d: rounded(cleaning.loss_report(X.records(s, d), cleaning.since(X.records(s, d), 1997)), "loss_percent"), f"WITH {RECORDS} SELECT count(*) AS rows_in, count(*) FILTER (WHERE year >= 1997) AS rows_out, round((count(*) - count(*) FILTER (WHERE year >= 1997)) * 100.0 / count(*), 6) AS loss_percent FROM records"),
    "in_category": (lambda s, d: filters.in_category(X.named_facts(s, d), "few", {"few": {"class": ["Brand#11", "Brand#12"], "order": [7, 9]}}).select("cell", "species_id", "n_obs"), f"WITH {NAMED} SELECT cell, species_id, n_obs FROM named WHERE class IN ('Brand#11', 'Brand#12') OR \"order\" IN (7, 9)"),
    "category_counts": (lambda s, d: explore.category_counts(filters.in_kingdoms(X.named_facts(s, d), {"ECONOMY": True, "PROMO": True, "SMALL": False})), f"WITH {NAMED} SELECT count(DISTINCT species_id) AS n_species, CAST(coalesce(sum(n_obs), 0) AS BIGINT) AS n_observations FROM named WHERE kingdom IN ('ECONOMY', 'PROMO')"),
    "well_observed": (lambda s, d: filters.well_observed(X.facts(s, d), 30), f"WITH {FACTS} SELECT * FROM facts WHERE species_id IN (SELECT species_id FROM facts GROUP BY 1 HAVING sum(n_obs) > 29)"),
    "retained_share": (lambda s, d: rounded(filters.retained_share(X.facts(s, d), 30), "percent"), f"WITH {FACTS}, t AS (SELECT species_id, sum(n_obs) AS n FROM facts GROUP BY 1) SELECT count(*) AS species_in, count(*) FILTER (WHERE n > 29) AS species_kept, round(count(*) FILTER (WHERE n > 29) * 100.0 / count(*), 6) AS percent FROM t"),
    "shown": (lambda s, d: filters.shown(X.facts(s, d), ["cell", "n_obs", "cell"], "n_obs"), f"WITH {FACTS} SELECT cell, n_obs FROM facts"),
    "per_cell": (lambda s, d: rounded(normalise.per_cell(X.facts(s, d)), "n_obs_per_cell"), f"WITH {FACTS} SELECT *, {_share('n_obs', 'cell', 'facts')} AS n_obs_per_cell FROM facts"),
    "per_species": (lambda s, d: rounded(normalise.per_species(X.facts(s, d)), "n_obs_per_species"), f"WITH {FACTS} SELECT *, {_SHARE.format(v='n_obs', k='species_id', t='10000')} AS n_obs_per_species FROM facts"),
    "per_clade": (lambda s, d: rounded(normalise.per_clade(X.named_facts(s, d)).select("cell", "species_id", "n_obs_per_kingdom"), "n_obs_per_kingdom"), f"WITH {NAMED} SELECT cell, species_id, {_share('n_obs', 'kingdom', 'named')} AS n_obs_per_kingdom FROM named"),
    "per_cell_and_clade": (lambda s, d: rounded(normalise.per_cell_and_clade(X.named_facts(s, d), "class").select("cell", "species_id", "n_obs_per_cell_and_class"), "n_obs_per_cell_and_class"), f"WITH {NAMED} SELECT cell, species_id, {_share('n_obs', 'cell, class', 'named')} AS n_obs_per_cell_and_class FROM named"),
    "per_period": (lambda s, d: rounded(normalise.per_period(X.facts_by_period(s, d)), "n_obs_per_period"), f"WITH {PERIODS} SELECT *, {_share('n_obs', 'period', 'periods')} AS n_obs_per_period FROM periods"),
    "presence": (lambda s, d: normalise.presence(X.facts(s, d)), f"WITH {FACTS} SELECT *, CAST(CASE WHEN n_obs > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_obs_unique FROM facts"),
    "logarithm": (lambda s, d: rounded(normalise.logarithm(X.measured(s, d), "n_obs_quantity").select("cell", "species_id", "n_obs_quantity_log"), "n_obs_quantity_log"), f"WITH {RECORDS}, m AS (SELECT cell, species_id, sum(quantity) AS q FROM records GROUP BY ALL) SELECT cell, species_id, round(log10(q / (SELECT min(q) FROM m WHERE q > 0)), 6) AS n_obs_quantity_log FROM m"),
    "normalise_all": (lambda s, d: rounded(normalise.all_in_one(X.named_facts(s, d)).drop("order"), "n_obs_per_species", "n_obs_per_cell_and_kingdom", "n_obs_per_cell_and_class", "n_obs_per_cell_and_species", "n_obs_log", "n_obs_per_cell_and_kingdom_log"), f"WITH {NAMED}, a AS (SELECT *, n_obs / sum(n_obs) OVER (PARTITION BY species_id) * 10000 AS p, n_obs / sum(n_obs) OVER (PARTITION BY cell, kingdom) AS c FROM named) SELECT cell, species_id, n_obs, kingdom, class, species, CAST(1 AS INTEGER) AS n_obs_unique, round(p, 6) AS n_obs_per_species, {_share('n_obs', 'cell, kingdom', 'named')} AS n_obs_per_cell_and_kingdom, {_share('n_obs', 'cell, class', 'named')} AS n_obs_per_cell_and_class, {_share('n_obs', 'cell, species', 'named')} AS n_obs_per_cell_and_species, round(log10(n_obs / (SELECT min(n_obs) FROM named)), 6) AS n_obs_log, round(log10(c / (SELECT min(c) FROM a)), 6) AS n_obs_per_cell_and_kingdom_log FROM a"),
    "richness": (lambda s, d: indices.richness(X.facts(s, d)), f"WITH {FACTS} SELECT cell, count(DISTINCT species_id) AS n_species FROM facts WHERE n_obs > 0 GROUP BY cell"),
    "effort": (lambda s, d: indices.effort(X.facts(s, d)), f"WITH {FACTS} SELECT cell, CAST(sum(n_obs) AS BIGINT) AS n_observations FROM facts GROUP BY cell"),
    "shannon": (lambda s, d: rounded(indices.shannon_index(X.facts(s, d)), "shannon"), f"WITH {SUMMED} SELECT cell, round(-sum(n_obs / s * log10(n_obs / s)), 6) AS shannon FROM facts JOIN totals USING (cell) GROUP BY cell"),
    "simpson": (lambda s, d: rounded(indices.simpson_index(X.facts(s, d)), "simpson"), f"WITH {SUMMED} SELECT cell, round(1 - sum(pow(n_obs / s, 2)), 6) AS simpson FROM facts JOIN totals USING (cell) GROUP BY cell"),
    "endemism": (lambda s, d: rounded(indices.endemism(X.facts(s, d)), "endemism"), f"WITH {FACTS}, area AS (SELECT species_id, count(*) AS a FROM facts GROUP BY 1) SELECT cell, round(sum(1.0 / a), 6) AS endemism FROM facts JOIN area USING (species_id) GROUP BY cell"),
    "diversity_indices": (lambda s, d: rounded(indices.diversity_indices(X.facts_by_period(s, d)), "shannon", "simpson", "endemism"), f"WITH {PERIODS}, t AS (SELECT cell, CAST(sum(n_obs) AS DOUBLE) AS s FROM periods GROUP BY cell), f AS (SELECT cell, species_id, CAST(sum(n_obs) AS BIGINT) AS v, count(*) AS k FROM periods GROUP BY ALL), area AS (SELECT species_id, count(*) AS a FROM periods GROUP BY 1) SELECT cell, count(*) AS n_species, CAST(sum(v) AS BIGINT) AS n_observations, round(-sum(v / s * log10(v / s)), 6) AS shannon, round(1 - sum(pow(v / s, 2)), 6) AS simpson, round(sum(CAST(k AS DOUBLE) / a), 6) AS endemism FROM f JOIN t USING (cell) JOIN area USING (species_id) GROUP BY cell"),
    "top_species": (lambda s, d: explore.top_species(X.facts(s, d), X.dimension(s, d)), f'WITH {FACTS}, {DIM} SELECT species_id, CAST(sum(n_obs) AS BIGINT) AS n_obs, kingdom, class, "order", species FROM facts JOIN dim USING (species_id) GROUP BY ALL'),
    "search_species": (lambda s, d: explore.search_species(X.named_facts(s, d), "BLUE", X.dimension(s, d).select("species_id", "species")), f"WITH {NAMED} SELECT species_id, CAST(sum(n_obs) AS BIGINT) AS n_obs, species FROM named WHERE contains(lower(species), 'blue') OR contains(lower(kingdom), 'blue') OR contains(lower(class), 'blue') GROUP BY ALL"),
    "explore_clade": (lambda s, d: explore.explore_clade(X.named_facts(s, d), "kingdom", "PROMO"), f"WITH {NAMED} SELECT class, count(DISTINCT species_id) AS n_species, CAST(sum(n_obs) AS BIGINT) AS n_obs, round_even(sum(n_obs) / count(DISTINCT species_id), 1) AS obs_per_species FROM named WHERE kingdom = 'PROMO' GROUP BY class"),
    "protected_species": (_protected, f"WITH {RECORDS} SELECT species_id, count(*) AS n_obs FROM records WHERE cell BETWEEN 1 AND 20 AND discount > 0.05 GROUP BY ALL"),
    "cell_profile": (lambda s, d: explore.cell_profile(X.facts(s, d), [3, 5, 8], X.dimension(s, d).select("species_id", "species")), f"WITH {NAMED} SELECT species_id, CAST(sum(n_obs) AS BIGINT) AS n_obs, species FROM named WHERE cell IN (3, 5, 8) GROUP BY ALL"),
    "grid_summary": (lambda s, d: explore.grid_summary(X.facts(s, d)), f"WITH {FACTS}, c AS (SELECT cell, sum(n_obs) AS o, count(*) FILTER (n_obs > 0) AS s FROM facts GROUP BY cell) SELECT " + ", ".join(f"CAST(trunc({e}) AS BIGINT) AS {n}_{k}" for n, v in (("observations", "o"), ("species", "s")) for k, e in (("mean", f"avg({v})"), ("median", f"quantile_cont({v}, 0.5)"), ("p10", f"quantile_cont({v}, 0.1)"), ("p90", f"quantile_cont({v}, 0.9)"))) + " FROM c"),
    "site_means": (lambda s, d: rounded(explore.site_means(indices.effort(X.facts(s, d)).join(X.cell_labels(s, d), "cell"), "cluster", ["n_observations"]), "n_observations"), f"WITH {FACTS}, e AS (SELECT cell, sum(n_obs) AS n FROM facts GROUP BY cell) SELECT CAST(s_nationkey % 5 AS INTEGER) AS cluster, round(avg(n), 6) AS n_observations FROM e JOIN supplier ON s_suppkey = cell GROUP BY ALL"),
    "sums_by": (lambda s, d: explore.sums_by(X.named_facts(s, d), [1, 2, 3, 4, 5], "class", ["n_obs"]), f"WITH {NAMED} SELECT class, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM named WHERE cell IN (1, 2, 3, 4, 5) GROUP BY class"),
    "top_of_each": (lambda s, d: explore.top_of_each(X.facts(s, d), "cell", "n_obs", 5, ["species_id"]), f"WITH {FACTS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cell ORDER BY n_obs DESC, species_id) AS INTEGER) AS rank FROM facts) WHERE rank <= 5"),
    "rank_of": (lambda s, d: explore.rank_of(explore.sums_by(X.named_facts(s, d), [1, 2, 3], "class", ["n_obs"]), "n_obs", ["class"]), f"WITH {NAMED} SELECT class, n_obs, CAST(row_number() OVER (ORDER BY n_obs DESC, class) - 1 AS INTEGER) AS place FROM (SELECT class, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM named WHERE cell IN (1, 2, 3) GROUP BY class)"),
    "name_counts": (lambda s, d: names.name_counts(X.vernacular(s, d)), "SELECT source AS taxon_id, lang AS language, lower(split_part(text, ' ', 1)) AS name, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL"),
    "common_names": (lambda s, d: names.common_names(X.vernacular(s, d)).select("taxon_id", "language", F.lower("name").alias("name")), "WITH c AS (SELECT source AS taxon_id, lang AS language, lower(split_part(text, ' ', 1)) AS name, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL) SELECT taxon_id, language, name FROM (SELECT *, row_number() OVER (PARTITION BY taxon_id, language ORDER BY n DESC, name COLLATE \"C\") AS r FROM c) WHERE r = 1".replace(' COLLATE "C"', "")),
    "turnover": (lambda s, d: rounded(temporal.turnover(X.facts_by_period(s, d)), "rate_lost", "rate_new"), f"WITH {PERIODS}, p AS (SELECT cell, species_id, max(CAST(period LIKE 'Période 1:%' AS INTEGER)) AS a, max(CAST(period LIKE 'Période 2:%' AS INTEGER)) AS b, count(*) AS k FROM periods GROUP BY ALL), c AS (SELECT cell, CAST(sum(k) AS BIGINT) AS n_total, CAST(sum(a) AS BIGINT) AS n_p1, CAST(sum(b) AS BIGINT) AS n_p2, CAST(sum(a * b) AS BIGINT) AS n_p1_and_p2 FROM p GROUP BY cell) SELECT *, n_p1 - n_p1_and_p2 AS n_p1_not_p2, n_p2 - n_p1_and_p2 AS n_p2_not_p1, round(CASE WHEN n_p1 > 0 THEN (n_p1 - n_p1_and_p2) / n_p1 * 100 END, 6) AS rate_lost, round((n_p2 - n_p1_and_p2) / n_total * 100, 6) AS rate_new FROM c"),
    "status_map": (lambda s, d: temporal.status_map(X.facts_by_period(s, d)).drop("periods"), f"WITH {PERIODS}, p AS (SELECT cell, species_id, max(CAST(period LIKE 'Période 1:%' AS INTEGER)) AS a, max(CAST(period LIKE 'Période 2:%' AS INTEGER)) AS b, max(CAST(period LIKE 'Période 3:%' AS INTEGER)) AS c FROM periods GROUP BY ALL) SELECT cell, species_id, CASE a * 100 + b * 10 + c " + " ".join(f"WHEN {k[0] * 100 + k[1] * 10 + k[2]} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in temporal.STATUS.items()) + " END AS status FROM p"),
    "two_periods": (lambda s, d: temporal.two_periods(X.facts_by_period(s, d), [C.period_label(THREE, 0), C.period_label(THREE, 1)], ("old", "new")), f"WITH {PERIODS} SELECT cell, species_id, CASE WHEN period LIKE 'Période 3%' THEN 'new' ELSE 'old' END AS period, n_obs FROM periods"),
    "winsorised": (lambda s, d: outliers.winsorised(X.facts(s, d)), f"WITH {FACTS}, q AS (SELECT species_id, round_even(quantile_cont(n_obs, 0.98), 0) AS b FROM facts GROUP BY 1) SELECT facts.*, CAST(least(n_obs, b) AS DOUBLE) AS n_obs_corrected FROM facts JOIN q USING (species_id)"),
    "replace_flagged": (_flagged, f"WITH {FACTS}, q AS (SELECT species_id, round_even(quantile_cont(n_obs, 0.99), 0) AS b FROM facts GROUP BY 1) SELECT cell, species_id, CAST(CASE WHEN cell % 10 = 0 THEN b ELSE n_obs END AS DOUBLE) AS n_obs FROM facts JOIN q USING (species_id)"),
    "put_back": (_put_back, f"WITH {FACTS}, q AS (SELECT species_id, round_even(quantile_cont(n_obs, 0.98), 0) AS b FROM facts WHERE cell % 2 = 0 GROUP BY 1) SELECT cell, species_id, CAST(CASE WHEN cell % 2 = 0 THEN least(n_obs, b) ELSE n_obs END AS DOUBLE) AS n_obs FROM facts LEFT JOIN q USING (species_id)"),
    "forest_vote": (lambda s, d: outliers.forest_vote(X.facts(s, d), rounds=10, contamination=0.01).select("cell", "species_id", "n_obs", "outlier"), None),
}
