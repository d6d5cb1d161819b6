"""Institution lists, ranking files, country metadata and exports."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import country_code, fold

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
# Headers of institution files.
HEADERS = {
    "name": ["institution", "university", "universidad", "universidade", "institucion", "name", "nombre", "nome"],
    "country": ["country", "pais"],
    "country_code": ["country code", "code", "codigo pais", "iso2"],
    "base_url": ["website", "url", "web", "sitio web", "homepage", "base url"],
    "language": ["language", "idioma", "lingua"],
    "max_depth": ["max depth"],
    "max_pages": ["max pages"],
}


def decode(data: bytes) -> str:
    """The first encoding that fits, else with replacement marks."""
    for e in ENCODINGS:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def _plain(header: str) -> str:
    t = "".join(c for c in unicodedata.normalize("NFKD", header.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[a-z0-9]+", t))


def resolve_headers(headers: list[str]) -> dict[str, str]:
    """Field -> header: the exact normalised name, else one that holds it as whole words; seed columns by their substring."""
    plain = {h: _plain(h) for h in headers}
    out: dict[str, str] = {}
    for field, names in HEADERS.items():
        hit = next((h for n in names for h, p in plain.items() if p == n), None) or next((h for n in names for h, p in plain.items() if re.search(rf"\b{n}\b", p) and "seed" not in p), None)
        if hit and hit not in out.values():
            out[field] = hit
    seed = next((h for h, p in plain.items() if "seed" in p or "catalog" in p or "semilla" in p), None)
    if seed:
        out["seed_urls"] = seed
    return out


def institutions_from(df: DataFrame) -> DataFrame:
    """Normalised institutions (name, country, country_code, base_url, catalog_urls, has_manual_seeds, language, max_depth, max_pages)
    of a table with any resolvable headers. Rows without a name, or without any address, are left out."""
    found = resolve_headers(df.columns)
    if "name" not in found:
        raise ValueError(f"no name column in {df.columns}")
    col = lambda f: F.trim(F.col(f"`{found[f]}`").cast("string")) if f in found else F.lit(None).cast("string")
    http = lambda c: F.when(c.rlike(r"^https?://"), c).when(c.contains("."), F.concat(F.lit("https://"), c))
    base = http(F.nullif(col("base_url"), F.lit("")))
    seeds = F.filter(F.transform(F.split(F.coalesce(col("seed_urls"), F.lit("")), r"[;|\n,]"), lambda u: F.trim(u)), lambda u: u != "")
    seeds = F.array_distinct(F.filter(F.transform(seeds, lambda u: F.coalesce(http(u), F.concat(F.regexp_extract(base, r"^(https?://[^/]+)", 1), F.lit("/"), u))), lambda u: u.isNotNull()))
    out = df.select(col("name").alias("name"), col("country").alias("country"), F.upper(col("country_code")).alias("given"), base.alias("base_url"), seeds.alias("seeds"), col("language").alias("language"), *(F.expr(f"try_cast(`{found[f]}` as int)").alias(f) if f in found else F.lit(None).cast("int").alias(f) for f in ("max_depth", "max_pages")))
    out = out.withColumn("base_url", F.coalesce("base_url", F.concat(F.regexp_extract(F.get("seeds", F.lit(0)), r"^(https?://[^/]+)", 1), F.lit("/"))))
    code = F.coalesce(country_code(F.col("country")), F.when(F.col("given").rlike("^[A-Z]{2}$"), F.col("given")), F.lit(""))
    return out.where(F.coalesce(F.col("name") != "", F.lit(False)) & F.col("base_url").isNotNull()).select("name", "country", code.alias("country_code"), "base_url", F.when(F.size("seeds") > 0, F.col("seeds")).otherwise(F.array("base_url")).alias("catalog_urls"), (F.size("seeds") > 0).alias("has_manual_seeds"), "language", "max_depth", "max_pages")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose encoding and separator are found from its first bytes; rows too short or long are padded or cut."""
    fs, p = _file_system(spark, path)
    files = [x.getPath() for x in fs.listStatus(p) if x.isFile()]  # the file itself, or those of a folder
    stream = fs.open(files[0])
    head = bytes(stream.readNBytes(65536))
    stream.close()
    text = decode(head)
    encoding = next((e for e in ENCODINGS if _fits(head, e)), "utf-8")
    sep = max([",", ";", "\t"], key=text.splitlines()[0].count if text.splitlines() else lambda s: 0)
    return spark.read.csv(path, header=True, sep=sep, encoding="UTF-8" if encoding.startswith("utf") else "windows-1252", multiLine=True, quote='"', escape='"')


def _fits(head: bytes, encoding: str) -> bool:
    try:
        head.decode(encoding)
    except UnicodeDecodeError as e:
        return e.start > len(head) - 4  # a character cut at the end
    return True


def rank_number(c: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"\d+", 0), F.lit("")).cast("int"), fallback)


def valid_ranking(df: DataFrame, seq: str, name: str, country: str) -> DataFrame:
    """(rank, name, code): rows with a name and a known country, the first per country and folded name; the rank is the position."""
    from ..operators.dedupe import keep_first

    rows = df.select(F.col(seq).alias("rank"), F.trim(F.col(name)).alias("name"), country_code(F.col(country)).alias("code")).where((F.col("name") != "") & F.col("code").isNotNull())
    return keep_first(rows.withColumn("k", F.regexp_replace(fold(F.col("name")), "[^a-z0-9]+", " ")), ["code", "k"], "rank").drop("k")


def ranking_by_country(valid: DataFrame) -> DataFrame:
    return valid.groupBy(F.col("code").alias("country_code")).agg(F.min("rank").alias("qs_top_rank"), F.min_by("name", F.struct("rank", "name")).alias("qs_top_university"), F.count("*").alias("qs_universities_in_ranking"))


def enrich_countries(codes: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Left joins of country dimensions; later ones override columns of the same name. The optimizer picks the join by their size."""
    out = codes.select("country_code").where(F.col("country_code").rlike("^[A-Z]{2}$")).distinct()
    for d in dimensions:
        out = out.drop(*[c for c in d.columns if c != "country_code"]).join(d, "country_code", "left")
    return out


def latest_observation(series: DataFrame) -> DataFrame:
    """(country_code, indicator, value, year): the first that isn't null of observations (country_code, indicator, year, value), newest first; 4 decimals, half up."""
    v = F.round(F.col("value").cast("decimal(38,10)"), 4).cast("double")
    return series.where(F.col("value").isNotNull()).groupBy("country_code", "indicator").agg(F.max_by(v, "year").alias("value"), F.max("year").alias("year"))


def refresh_cache(cache: DataFrame, fresh: DataFrame, ttl_days: int, now: Column) -> DataFrame:
    """(key, value): a fresh value where one came, else the cached one, marked stale beyond its age."""
    j = cache.select("key", F.col("value").alias("old"), "fetched_at").join(fresh.select("key", F.col("value").alias("new")), "key", "full")
    return j.select("key", F.coalesce("new", "old").alias("value"), (F.col("new").isNull() & (F.col("fetched_at") + F.expr(f"INTERVAL {ttl_days} DAYS") < now)).alias("stale"))


def country_facts(spark: SparkSession) -> DataFrame:
    """The literal country dimension; a row a country, small whatever the data."""
    names = "country_code string, times_top_rank int, scimago_country_rank_physics int, ibm_quantum_network_member boolean, national_quantum_initiative boolean, latam_quantum_alliance_member boolean"
    return spark.createDataFrame(lx.COUNTRY_FACTS, names).withColumn("manual_data_reference_year", F.lit(2024))


def indicator_columns(observations: DataFrame) -> DataFrame:
    """A row a country with value and year of each indicator; observations (country_code, indicator, year, value)."""
    latest = latest_observation(observations)
    cols = [c for name, code in lx.INDICATORS.items() for c in (F.max(F.when(F.col("indicator") == code, F.col("value"))).alias(name), F.max(F.when(F.col("indicator") == code, F.col("year").cast("string"))).alias(f"{name}_year"))]
    return latest.groupBy("country_code").agg(*cols)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _joined(df: DataFrame, path: str, head: bytes, tail: bytes, drop: int) -> None:
    """One file on any file system Spark knows: the executors write lines, their parts are joined as bytes behind `head`, without the last
    `drop` bytes of the last part, and the file is put in place by a rename. No row passes through Python or the driver's memory."""
    spark = df.sparkSession
    fs, target = _file_system(spark, path)
    parts, made = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{x}") for x in ("parts", "tmp"))
    fs.delete(parts, True)
    df.write.text(parts.toString())
    files = sorted((f for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-") and f.getLen() > 0), key=lambda f: f.getPath().getName())
    out = fs.create(made, True)
    out.write(bytearray(head))
    for n, f in enumerate(files):
        source = fs.open(f.getPath())
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, f.getLen() - (drop if n == len(files) - 1 else 0))
        source.close()
    out.write(bytearray(tail))
    out.close()
    fs.delete(target, False)
    if not fs.rename(made, target):
        raise OSError(f"could not put {path} in place")
    fs.delete(parts, True)


def export_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """One CSV file with a byte-order mark; rows in the order of the DataFrame, nulls empty, fields quoted where they must be."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    field = lambda c: F.when(text(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns) + "\n"
    _joined(df.select(F.concat_ws(",", *map(field, df.columns)).alias("value")), path, (b"\xef\xbb\xbf" if bom else b"") + head.encode(), b"", 0)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON array, non-ASCII kept, nulls written."""
    line = F.concat(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}), F.lit(","))
    _joined(df.select(line.alias("value")), path, b"[\n", b"\n]\n", 2)
