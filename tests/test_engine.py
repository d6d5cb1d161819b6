import io
import zipfile

from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.functions import urls
from sparkloom.operators import dedupe, essays, matching, rollup, seeds, stats
from sparkloom.plans import catalog
from sparkloom.sources import html, loaders


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def classes(spark, rows):
    df = spark.createDataFrame(rows, "id long, raw_text string, source_type string, source_url string, media_type string")
    return matching.classify(df, "id").select("id", "category", "title", "classification", "confidence").collect()


def test_computing_course_is_core(spark):
    out = classes(spark, [(1, "Quantum Computing. 4 credits. Introduction to qubits and quantum algorithms.", "catalog", "u", "html")])
    assert {r.classification for r in out if r.category == "quantum_computing"} == {"qise_core"}


def test_mechanics_is_adjacent_never_core(spark):
    out = classes(spark, [(1, "Mecánica Cuántica I | 6 créditos | Plan de Física", "curriculum_grid", "u", "html")])
    assert {r.classification for r in out} == {"quantum_foundations_or_adjacent"}


def test_seminar_is_contextual(spark):
    out = classes(spark, [(1, "Seminario y conferencia de divulgación sobre computación cuántica, agenda abierta", "html_page", "u", "html")])
    assert out and {r.classification for r in out} == {"non_course_or_contextual"}


def test_prerequisite_is_no_course_and_titles_part(spark):
    text = "Mecánica Cuántica 1  4 créditos\nMecánica Cuántica 2  4 créditos\nMecánica Cuántica Relativista  4 créditos\nFísica Térmica  4 créditos  Prerrequisito: Mecánica Cuántica 1"
    out = [r for r in classes(spark, [(1, text, "curriculum_grid", "u", "pdf")]) if r.category == "quantum_mechanics"]
    assert sorted(r.title for r in out) == ["Mecánica Cuántica 1 4 créditos", "Mecánica Cuántica 2 4 créditos", "Mecánica Cuántica Relativista 4 créditos"]


def test_null_and_empty_texts_match_nothing(spark):
    assert classes(spark, [(1, None, "catalog", "u", "html"), (2, "", "catalog", None, None)]) == []


def test_offsets_fall_on_the_original(spark):
    df = spark.createDataFrame([(1, "Óptica cuántica y óptica  cuántica, qubits")], "id long, t string")
    m = matching.with_matches(df, "t")
    got = m.select("phrase", F.substring("t", F.col("start") + 1, F.col("end") - F.col("start")).alias("s")).collect()
    assert sorted(tuple(r) for r in got if r.phrase == "optica cuantica") == [("optica cuantica", "Óptica cuántica"), ("optica cuantica", "óptica  cuántica")]


def test_keep_best_ties(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 3, 0, "z"), (None, 4, None, "n")], "k string, seq int, rank int, v string")
    assert {r.k: r.v for r in dedupe.keep_best(df, ["k"], "rank", "seq").collect()} == {"a": "x", None: "n"}
    assert {r.k: r.v for r in dedupe.keep_best(df, ["k"], "rank", "seq", latest=True).collect()} == {"a": "y", None: "n"}
    assert dedupe.keep_best(df.limit(0), ["k"], "rank", "seq").count() == 0


def test_title_key(spark):
    c = tx.title_key(F.col("t"))
    assert one(spark, c, t="MF719 Simetrías discretas") == one(spark, c, t="Simetrías discretas") == "simetrias discretas"


def test_levels_languages_sources(spark):
    assert one(spark, tx.academic_level(F.col("t")), t="plan de estudios de pregrado") == "undergraduate"
    assert one(spark, tx.academic_level(F.col("t")), t="pregrado y posgrado") == ""
    assert one(spark, tx.language_rules(F.col("t")), t="ementa da disciplina, graduação") == "pt"
    assert one(spark, tx.language_rules(F.col("t")), t="") == "unknown"
    assert one(spark, tx.source_type_rules(F.col("u"), F.col("t"), F.lit(False)), u="https://u.edu/x", t="malla curricular") == "curriculum_grid"


def test_addresses(spark):
    d = urls.registered_domain(F.col("h"))
    assert [one(spark, d, h=h) for h in ("portal.uni.edu.pe", "www5.usp.br", "utec.edu.pe", "ib.edu.ar")] == ["uni.edu.pe", "usp.br", "utec.edu.pe", "ib.edu.ar"]
    assert one(spark, urls.without_tracking(F.col("u")), u="https://u.edu/x/?tmpl=component&print=1#a") == "https://u.edu/x"
    assert one(spark, urls.url_hash(F.col("u")), u="https://utec.edu.pe/carreras/fisica") == "0a44ab486ff5"
    assert one(spark, urls.external_document(F.col("u")), u="https://docs.google.com/spreadsheets/d/ABC_12/edit").endswith("ABC_12/export?format=xlsx")
    assert one(spark, urls.external_document(F.col("u")), u="https://u.edu/") == ""
    assert one(spark, urls.join_url(F.col("b"), F.col("r")), b="https://u.edu/a/", r="../p.pdf") == "https://u.edu/p.pdf"


def test_seed_scores_order(spark):
    score = lambda u, m: one(spark, seeds.seed_score(F.col("u"), F.col("a"), F.lit(m)), u=u, a="")
    hi, mid, lo = score("https://u.edu/facultad/fisica/plan-de-estudios.pdf", True), score("https://u.edu/facultad/derecho", False), score("https://u.edu/noticias/evento-deportivo", False)
    assert hi > mid > lo and lo < 0


def test_link_priority(spark):
    p = seeds.link_priority(F.col("u"), F.col("a"))
    assert [one(spark, p, u=u, a="") for u in ("https://u.edu/fisica/plan-de-estudios", "https://u.edu/sociologia/plan-de-estudios", "https://u.edu/noticias/evento-cuantico", "https://u.edu/nosotros/historia")] == [2, 3, 5, 6]


def test_html(spark):
    page = "<html><title>T</title><nav>n</nav><table><tr><th>c</th><th>n</th></tr><tr><td>FIS-410</td><td>Computación Cuántica</td><td>4 créditos</td></tr></table><a href='/plan.pdf'>Plan</a><iframe src='https://x/doc'></iframe></html>"
    df = spark.createDataFrame([("u", page), ("v", None), ("w", "<div class='curso'>" + "curso de mecánica cuántica avanzada " * 2)], "u string, h string")
    out = html.html_fragments(df, "u", "h").collect()
    assert [r.raw_text for r in out if r.source_url == "u"] == ["FIS-410 | Computación Cuántica | 4 créditos"]
    assert {r.href for r in html.html_links(df, "u", "h").collect()} == {"/plan.pdf", "https://x/doc"}


def test_html_query_reads_whole_snippets_in_all_forms(spark, tmp_path):
    text = "Temas: a < b & c > d; " + "computación cuántica y óptica " * 10 + "fin"
    rows = [(k, "http://u", f"Curso {k}", text) for k in range(3)] + [(3, "http://u", None, text), (4, "http://u", None, None)]
    spark.createDataFrame(rows, "candidate_id long, source_url string, course_title string, evidence_snippet string").write.parquet(f"{tmp_path}/qise_candidates.parquet")
    out = {r.source_url: r for r in catalog.queries()["html_extract"](spark, str(tmp_path)).collect()}
    assert {k: (r.raw_text, r.coarse) for k, r in out.items()} == {
        "http://u#0": (f"Curso 0 | {text}", False), "http://u#1": (f"Curso 1 {text}", False), "http://u#2": (f"Curso 2\n{text}", True), "http://u#3": (f"- | {text}", False),
    }


def test_kmeans_profiles_takes_the_ten_starts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(float(k % 3), float(k % 2)) for k in range(12)], "l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    taken = []
    monkeypatch.setattr(catalog.stats, "kmeans", lambda df, features, k, restarts=10: taken.append(restarts) or (df.selectExpr("*", "0 as cluster"), 0.0))
    catalog.queries()["kmeans_profiles"](spark, str(tmp_path))
    assert taken == [10]


def test_sitemaps(spark):
    xml = "<urlset><url><loc>https://u.edu/a</loc></url><url><loc> https://u.edu/sitemap-posts.xml </loc></url><loc>ftp://x</loc></urlset>"
    assert one(spark, html.sitemap_urls(F.col("x")), x=xml) == ["https://u.edu/a", "https://u.edu/sitemap-posts.xml"]
    assert one(spark, html.robots_sitemaps(F.col("x")), x="User-agent: *\nSitemap: https://u.edu/sm.xml") == ["https://u.edu/sm.xml"]


def _workbook():
    b = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}"><sheets><sheet name="Plan"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c t="inlineStr"><is><t>FIS-401 Mecánica Cuántica</t></is></c><c><v>4</v></c><c t="inlineStr"><is><t>créditos del plan</t></is></c></row></sheetData></worksheet>')
    return b.getvalue()


def test_documents_are_never_dropped(spark):
    df = spark.createDataFrame([("a", bytearray(_workbook()), "xlsx"), ("b", bytearray(b"PK corrupt"), "xlsx"), ("c", bytearray(b"%PDF-1.6"), "pdf"), ("d", None, "pdf")], "url string, content binary, kind string")
    out = {r.source_url: r for r in html.document_fragments(df).collect()}
    assert out["a"].extraction_status == "extracted" and "Mecánica" in out["a"].raw_text
    assert {out[k].extraction_status for k in "bcd"} == {"needs_manual_review"}


def test_institutions(spark):
    df = spark.createDataFrame([("Con Seeds", "Perú", "https://a.edu.pe", "https://a.edu.pe/x|https://a.edu.pe/y"), ("Solo Dominio", "Brasil", "b.edu.br", None), (None, "Chile", "c.cl", None)], "institution string, country string, website string, seed_urls string")
    out = {r.name: r for r in loaders.institutions_from(df).collect()}
    assert out["Con Seeds"].has_manual_seeds and len(out["Con Seeds"].catalog_urls) == 2
    assert not out["Solo Dominio"].has_manual_seeds and out["Solo Dominio"].country_code == "BR"
    assert len(out) == 2


def test_statistics(spark):
    rows = [(True, True)] * 31 + [(True, False)] * 68 + [(False, True)] * 18 + [(False, False)] * 25
    out = stats.chi_square_yates(spark.createDataFrame(rows, "stem boolean, gone boolean"), "stem", "gone").first()
    assert abs(out.chi2 - 1.0458978381) < 1e-8 and abs(out.p - 0.3064537468) < 1e-8


def test_cosine_equals_brute_force(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, None)]
    out = {r.i: r.avg_similarity for r in essays.cosine_avg(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v").collect()}
    assert abs(out[1] - (2**-0.5 + 0) / 2) < 1e-12 and abs(out[2] - 2**-0.5) < 1e-12 and 4 not in out


def test_rollups(spark):
    df = spark.createDataFrame([(1, "u", "Perú", "PE", "qise_core"), (2, "u", "Chile", "CL", "odd"), (3, "v", None, None, None)], "seq int, institution string, country string, country_code string, classification string")
    out = {r.university: r for r in rollup.by_institution(df, "seq").collect()}
    assert (out["u"].country_code, out["u"].qise_core, out["u"].non_course, out["v"].non_course) == ("PE", 1, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    from sparkloom.streaming import keep_best

    rows = [("a", 1, 1, "x"), ("a", 2, 3, "y"), ("b", 3, 1, "z"), ("a", 4, 3, "w")]
    schema = "k string, seq int, rank int, v string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    keep_best.keep_best_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], "rank", "seq").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "v0"))
    assert sorted(got.collect()) == sorted(dedupe.keep_best(df, ["k"], "rank", "seq", latest=True).collect())


def test_documents_without_text_come_out_for_review(spark):
    rows = [(1, "Quantum Computing. 4 credits. qubits", "catalog", "u", "html", "extracted", ""), (2, "", "pdf", "https://u/a.pdf", "pdf", "needs_manual_review", "graduate"), (3, None, "pdf", "https://u/b.pdf", "pdf", "failed_pdf_extraction", None)]
    df = spark.createDataFrame(rows, "id long, raw_text string, source_type string, source_url string, media_type string, extraction_status string, academic_level_hint string")
    out = matching.classify(df, "id")
    review = {r.id: r for r in out.where("extraction_status <> 'extracted'").collect()}
    assert {(r.classification, r.confidence) for r in review.values()} == {("unclear", "low")} and review[2].academic_level == "graduate"
    assert review[2].evidence_snippet.startswith("PDF opened") and review[3].evidence_snippet.startswith("PDF could not")
    made = matching.to_rows(out, F.lit("2025-01-01T00:00:00Z"))
    assert made.columns == matching.OUTPUT and len(made.columns) == 23
    got = {r.source_url: r for r in made.collect()}
    assert got["https://u/b.pdf"].academic_level == "unknown" and got["u"].is_qise_core and not got["https://u/a.pdf"].is_qise_core


def test_summaries(spark):
    rows = [(1, "A", "Peru", "PE", "qise_core", "Curso X"), (2, "B", "Peru", "PE", "qise_core", "Curso X"), (3, "B", "Peru", "PE", "qise_core", ""), (4, "C", None, None, "unclear", "Y"), (5, None, None, "", None, None)]
    df = spark.createDataFrame(rows, "seq long, institution string, country string, country_code string, classification string, course_title string")
    assert [r.university for r in rollup.university_summary(df, "seq").collect()] == ["B", "A", "C", None]
    assert rollup.country_summary(rollup.by_institution(df, "seq")).first().universities == "A | B"
    assert [r.seq for r in rollup.unique_core_courses(df, "seq").collect()] == [1]
    codes = {r.country_code: r for r in rollup.by_country_code(df).collect()}
    assert codes["PE"].core_institutions == ["A", "B"] and codes["??"].rows == 2 and codes["PE"].institutions == 2
    assert tuple(rollup.crawl_totals(df.limit(0), ["seq"]).first()) == (0,)


def test_links_are_skipped_and_new_hosts_lifted(spark):
    rows = [("p", "https://fis.uni.edu/fisica/plan-de-estudios", "", 0), ("p", "https://fis.uni.edu/login", "", 1), ("p", "https://x.example.org/a.png", "", 2), ("p", "https://longname.example.org/nosotros", "", 3), ("p", "https://longname.example.org/otros", "", 4), ("p", "https://fc.uni.edu/nosotros", "", 5), ("p", None, None, 6)]
    out = {r.url: r.priority for r in seeds.link_candidates(spark.createDataFrame(rows, "page_url string, url string, anchor string, seq int")).collect()}
    assert out == {"https://fis.uni.edu/fisica/plan-de-estudios": 2, "https://longname.example.org/nosotros": 3, "https://longname.example.org/otros": 6, "https://fc.uni.edu/nosotros": 2}
    known = spark.createDataFrame([("longname.example.org",)], "host string")
    assert {r.priority for r in seeds.link_candidates(spark.createDataFrame(rows[3:4], "page_url string, url string, anchor string, seq int"), known).collect()} == {6}
    assert seeds.hard_skip(F.lit("https://u.edu/administracion")) is not None


def test_workbooks_by_their_bytes(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", "x")
    df = spark.createDataFrame([(1, bytearray(data.getvalue())), (2, bytearray(bytes.fromhex("D0CF11E0A1B11AE1"))), (3, bytearray(b"  %PDF-1.6")), (4, None)], "i int, c binary")
    assert {r.i: r.k for r in df.select("i", html.content_kind(F.col("c"), F.lit(None).cast("string"), F.lit("https://u/serve?id=1")).alias("k")).collect()} == {1: "xlsx", 2: "xls", 3: "pdf", 4: "html"}


def test_attendance(spark):
    from sparkloom.operators import attendance

    rows = [("VERDADERO", "FALSO", "FALSO", " Ingenieria de Software ", "a", ""), ("FALSO", "VERDADERO", None, "Derecho", " ", None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "d1 string, d2 string, d3 string, career string, c1 string, c2 string")
    df = df.select(*(attendance.flag(F.col(x)).alias(x) for x in ("d1", "d2", "d3")), attendance.clean_career(F.col("career")).alias("career"), "c1", "c2")
    out = attendance.with_flags(df, ["d1", "d2", "d3"], ["c1", "c2"]).withColumn("kind", attendance.career_class(F.col("career"))).collect()
    assert [(r.career, r.kind, r.total, r.dropout, r.commitment_days) for r in out] == [("ingeniería de software", "STEM", 1, 1, 1), ("derecho", "No STEM", 1, 0, 0), ("", "No STEM", 0, 0, 0)]
    assert tuple(attendance.day_sums(df, ["d1", "d2", "d3"]).first()) == (1, 1, 0)


def test_manual_entries_and_settings(spark, tmp_path):
    import pytest

    from sparkloom.sources import manual

    df = spark.createDataFrame([("PhD",), (" Pregrado ",), (None,), ("unknown",)], "l string")
    assert [r.x for r in df.select(manual.academic_level(F.col("l")).alias("x")).collect()] == ["graduate", "undergraduate", "unknown", "unknown"]
    with pytest.raises(Exception, match="invalid academic level"):
        spark.createDataFrame([("x",)], "l string").select(manual.academic_level(F.col("l"))).collect()
    rows = spark.createDataFrame([("unclear", "high", "a"), ("qise_core", "low", "b"), ("qise_core", "high", "c"), ("odd", "high", "d")], "classification string, confidence string, semantic_category string")
    assert [r.semantic_category for r in manual.report_order(rows).collect()] == ["c", "b", "a", "d"]
    old = spark.createDataFrame([("u", "high", 1), ("v", "low", 1)], "k string, confidence string, n int")
    new = spark.createDataFrame([("u", "low", 2), ("v", "low", 2)], old.schema)
    assert sorted((r.k, r.n) for r in manual.append(old, new, ["k"], "n").collect()) == [("u", 1), ("v", 2)]
    p = tmp_path / "list.json"
    p.write_text('{"universities": [{"name": "Uni", "country": "Perú", "website": "https://u.edu.pe/", "seed_urls": ["https://u.edu.pe/a"]}, {"name": "", "website": "x.y"}]}')
    assert [(r.name, r.country_code, r.catalog_urls) for r in manual.read_list(spark, str(p)).collect()] == [("Uni", "PE", ["https://u.edu.pe/a"])]
    with pytest.raises(ValueError):
        manual.read_list(spark, str(tmp_path / "a.txt"))
    assert manual.settings({"a": 1, "old": 2, "alias": 3}, {"alias": "a", "old": "new"}, {"new": 9, "z": None}) == {"a": 1, "new": 9}


def test_feeds(spark):
    from sparkloom.sources import feeds

    df = spark.createDataFrame([("s", "<rss><channel><item><title>T</title><description>cuerpo del texto</description><link>https://a</link></item></channel></rss>"), ("s", None), ("s", "<bad")], "n string, x string")
    assert [(r.raw_text, r.url) for r in feeds.valid_records(feeds.rss_records(df, "n", "x")).collect()] == [("T cuerpo del texto", "https://a")]
    reddit = spark.createDataFrame([("r", '{"data": {"children": [{"data": {"title": "T", "selftext": "x", "permalink": "/r/q/1", "created_utc": 0}}]}}'), ("r", None), ("r", "{")], "n string, x string")
    assert [(r.raw_text, r.url) for r in feeds.reddit_records(reddit, "n", "x").collect()] == [("T x", "https://www.reddit.com/r/q/1")]
    tweets = spark.createDataFrame([("t", '{"data": [{"id": "5", "text": "hola"}]}')], "n string, x string")
    assert [r.url for r in feeds.twitter_records(tweets, "n", "x").collect()] == ["https://twitter.com/i/web/status/5"]


def test_exports_round_trip(spark, tmp_path):
    import csv
    import json

    rows = [(1, 'a "q", b', None), (2, "línea\nnueva", True)]
    df = spark.createDataFrame(rows, "n int, t string, b boolean").coalesce(1)
    loaders.export_csv(df, f"{tmp_path}/x.csv")
    with open(f"{tmp_path}/x.csv", encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [["n", "t", "b"], ["1", 'a "q", b', ""], ["2", "línea\nnueva", "true"]]
    loaders.export_json(df, f"{tmp_path}/x.json")
    assert json.load(open(f"{tmp_path}/x.json", encoding="utf-8")) == [{"n": 1, "t": 'a "q", b', "b": None}, {"n": 2, "t": "línea\nnueva", "b": True}]
    loaders.export_csv(df.limit(0), f"{tmp_path}/e.csv")
    loaders.export_json(df.limit(0), f"{tmp_path}/e.json")
    assert open(f"{tmp_path}/e.csv", encoding="utf-8-sig").read() == "n,t,b\n" and json.load(open(f"{tmp_path}/e.json")) == []
    assert [r.t for r in loaders.read_csv(spark, f"{tmp_path}/x.csv").collect()] == ['a "q", b', "línea\nnueva"]


def test_country_dimensions(spark):
    seen = spark.createDataFrame([("PE", "NY.GDP.PCAP.CD", 2020, 1.23456), ("PE", "NY.GDP.PCAP.CD", 2022, None), ("PE", "IT.NET.USER.ZS", 2021, 70.0)], "country_code string, indicator string, year int, value double")
    out = loaders.enrich_countries(spark.createDataFrame([("PE",), ("XX",), ("bad",)], "country_code string"), loaders.country_facts(spark), loaders.indicator_columns(seen))
    got = {r.country_code: r for r in out.collect()}
    assert set(got) == {"PE", "XX"} and got["PE"].gdp_per_capita_usd == 1.2346 and got["PE"].gdp_per_capita_usd_year == "2020" and got["PE"].times_top_rank == 1001 and got["XX"].times_top_rank is None
