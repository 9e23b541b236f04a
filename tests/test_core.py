import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phytomill.functions import clean, text
from phytomill.functions.plaintext import plain, words
from phytomill.operators import acquire, evaluate, impute, regions, search, service, taxonomy, vector
from phytomill.sources import files, rest


def values(df, column):
    return [r[column] for r in df.collect()]


def test_clean(spark):
    rows = spark.createDataFrame([(" 7",), ("\t7",), ("7.0",), ("007",), ("nan",), (None,), ("x7",), ("",)], "t string")
    assert values(rows.select(clean.whole_number(F.col("t")).alias("n")), "n") == [7, 7, 7, 7, None, None, None, None]
    names = spark.createDataFrame([(" ROSA​ceae ",), ("N/A",), ("-",), ("​",)], "t string")
    assert values(names.select(clean.name(F.col("t")).alias("n")), "n") == ["Rosaceae", None, None, None]


def test_plain_text():
    assert words(plain("grÃ¶­Ã\x9fe <b>aus&shy;sen</b> seed-\ncoat")) == ["grosse", "aussen", "seedcoat"]
    assert words(plain("")) == []


def test_prompts(spark):
    ranks = ("Plantae", "Tracheophyta", "Magnoliopsida", "Ericales", "Ericaceae", "Rhododendron", "Rhododendron simsii")
    row = spark.range(1).select(
        text.path_prompt([F.lit(r) for r in ranks]).alias("p"), text.name_prompt(F.lit("Rhododendron simsii")).alias("s"),
        text.common_prompt(F.lit(" "), F.lit("Rhododendron simsii")).alias("f"), text.common_prompt(F.lit("azalea"), F.lit("x")).alias("c"),
        text.path_prompt([F.lit(None).cast("string"), F.lit(" ")]).alias("e"), text.safe_name(F.lit('a/b:c*d?e"f<g>h|i\\j')).alias("n"),
        text.resized_url(F.lit("https://x/1/square.jpg"), "medium").alias("u"), text.dir_key(F.lit("abc")).alias("d"),
        text.is_image(F.lit("A.JPG")).alias("i"), text.is_image(F.lit("c.gif")).alias("g"), text.url_suffix(F.lit("http://x/a?b=.png")).alias("x"),
    ).first()
    assert row.p == "a photo of " + " ".join(ranks)
    assert (row.s, row.f, row.c, row.e) == ("a photo of Rhododendron simsii", "a photo of Rhododendron simsii", "a photo of azalea", "")
    assert (row.n, row.u, row.d, row.i, row.g, row.x) == ("a_b_c_d_e_f_g_h_i_j", "https://x/1/medium.jpg", "abc", True, False, ".jpg")


def test_tiers(spark):
    sims = [0.35, 0.34996, 0.3499, 0.22, 0.2199, 0.0, -0.1]
    rows = spark.createDataFrame([(s,) for s in sims], "s double")
    got = rows.select(search.tier_of_percent(F.col("s")).alias("a"), search.tier_of_rounded(F.col("s")).alias("b")).collect()
    assert [r.a for r in got] == ["high", "high", "medium", "medium", "low", "low", "low"]
    assert [r.b for r in got][:2] == ["high", "medium"]
    record = spark.range(1).select(search.percent(F.lit(0.75159)).alias("p")).first()
    assert record.p == 75.16


def test_topk_ties_nulls_and_size(spark, monkeypatch):
    schema = "k bigint, embedding array<float>"
    index = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [math.nan, 1.0]), (6, [1.0])], schema)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q bigint, embedding array<float>")
    got = sorted((r["rank"], r["k"]) for r in search.topk(index, asked, 10, "k", "q").collect())
    assert got == [(1, 1), (2, 3), (3, 2)]
    assert search.topk(index, asked, 1, "k", "q", exclude_self=True).first()["k"] == 3
    assert search.topk(index.limit(0), asked, 3, "k", "q").count() == 0
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 1)
    twice = asked.withColumn("q", F.col("q") + 1000).union(asked)
    assert sorted((r["rank"], r["k"]) for r in search.topk(index, twice, 10, "k", "q").filter("q < 1000").collect()) == got
    assert search.topk(index, asked.limit(0), 3, "k", "q").count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, None), (2, [1.0, 0.0]), (2, [-1.0, 0.0])], "label int, e array<float>")
    means = vector.class_mean(rows, "label", "e", 2)
    got = {r.label: (r.n, [round(x, 4) for x in r["mean"]], r.covered) for r in vector.aligned_means(spark.createDataFrame([(1,), (2,), (3,)], "label int"), means, "label", 2).collect()}
    assert got == {1: (2, [0.7071, 0.7071], True), 2: (2, [0.0, 0.0], True), 3: (0, [0.0, 0.0], False)}
    one = spark.range(1).select(vector.ensemble(*[F.array(F.lit(3.0), F.lit(4.0))] * 3).alias("e"), vector.l2_normalize(F.array(F.lit(0.0))).alias("z")).first()
    assert [round(x, 6) for x in one.e] == [0.6, 0.8] and one.z is None


def test_taxonomy(spark):
    taxa = spark.createDataFrame([(1, [10, 11, 12], "species", "S"), (2, [99], "odd", "T")], "id bigint, ancestor_ids array<bigint>, rank string, name string")
    nodes = spark.createDataFrame([(10, "family", "A"), (11, "family", "B"), (12, "tribe", "C")], "node_id bigint, rank string, name string")
    got = {r.id: (r.family, r.species, r.kingdom) for r in taxonomy.pivot_ranks(taxa, nodes, "id").collect()}
    assert got == {1: ("B", "S", ""), 2: ("", "", "")}
    cache = spark.createDataFrame([("x",), ("",)], "phylum string")
    assert taxonomy.cache_valid(cache, ["phylum"]).first().valid is False
    assert taxonomy.cache_valid(cache.filter("phylum <> ''"), ["phylum"]).first().valid is True
    assert taxonomy.cache_valid(cache, ["phylum", "genus"]).first().valid is False


def test_acquire(spark):
    rows = spark.range(7).select(F.col("id").alias("k"))
    first = sorted(values(acquire.sample_exact(rows, "k", 0.8), "k"))
    assert len(first) == 5 and first == sorted(values(acquire.sample_exact(rows.repartition(3), "k", 0.8), "k"))
    counts = spark.createDataFrame([("a", 5), ("b", 7), ("c", 3)], "k string, existing bigint")
    assert [(r.k, r.need) for r in acquire.gaps(counts, 5).collect()] == [("c", 2)]
    assert acquire.page_plan(5001, 500, spark).count() == 11
    assert values(acquire.id_batches(spark.range(65), "id").orderBy("batch"), "ids")[2] == "60,61,62,63,64"
    assert acquire.sample_exact(rows.limit(0), "k", 0.8).count() == 0


def test_regions(spark):
    features = spark.createDataFrame([("A", "a"), ("A", None), ("B", ""), (None, "n"), ("C", "c")], "code string, name string")
    codes = spark.createDataFrame([("A",), ("B",), ("A",)], "code string")
    native, background = regions.native_regions(features, codes, "code", "name"), regions.background_regions(features, codes, "code")
    assert sorted(tuple(r) for r in native.collect()) == [("A", "A"), ("A", "a"), ("B", "B")]
    assert native.count() + background.count() == features.count()
    assert tuple(regions.match_stats(features, codes, "code").first()) == (2, 3)
    assert regions.name_to_id(spark.createDataFrame([("x", "1")], "name string, id string"), "  ").count() == 0
    assert "N/A" in regions.map_page("{}", "{}", "n", {"climate": None}) and regions.map_file_name("a b") == "a_b_native.html"


def test_metrics(spark, monkeypatch):
    rng = np.random.default_rng(0)
    means = rng.integers(-2, 3, size=(7, 4)).astype(float)
    rows = [(k, int(rng.integers(7)), rng.integers(-2, 3, size=4).astype(float).tolist()) for k in range(300)]
    df = spark.createDataFrame([*rows, (900, None, [0.0] * 4), (901, 3, None)], "k bigint, label int, v array<double>")
    prototypes = spark.createDataFrame([(c, m.tolist()) for c, m in enumerate(means)], "label int, mean array<double>")
    s = np.array([v for _, _, v in rows]) @ means.T
    own = np.array([c for _, c, _ in rows])
    order = np.lexsort((np.tile(np.arange(7), (300, 1)), -s), axis=1)
    aucs = [np.mean((s[own == c, c][:, None] > s[own != c, c]) + (s[own == c, c][:, None] == s[own != c, c]) / 2) for c in range(7)]
    for classes, positives in ((16_384, 1_000_000), (3, 40)):  # one block and several
        monkeypatch.setattr(evaluate, "CLASSES_AT_ONCE", classes)
        monkeypatch.setattr(evaluate, "POSITIVES_AT_ONCE", positives)
        ranks = evaluate.class_ranks(df, prototypes, "k", "label", "v")
        got = {r.k: (r.predicted, r.score, r["rank"]) for r in ranks.collect()}
        assert got == {k: (order[k, 0], s[k].max(), order[k].tolist().index(own[k]) + 1) for k in range(300)}
        assert evaluate.accuracy_at_k(ranks).first().acc3 == round(np.mean([got[k][2] <= 3 for k in got]), 6)
        assert abs(evaluate.macro_auc(evaluate.class_areas(df, prototypes, "k", "label", "v")).first().macro_auc - np.mean(aucs)) < 2e-6
    assert evaluate.class_ranks(df.limit(0), prototypes, "k", "label", "v").count() == 0


def test_group_fill(spark):
    rows = [(1, "s", "f", "x", 1), (2, "s", "f", None, None), (3, "t", "f", "y", 3), (4, "t", "f", "z", 9), (5, "t", "f", None, None), (6, None, None, None, None), (6, None, None, None, None), (7, "u", "g", "p", 2), (8, "v", "g", "q", 4), (9, "w", "g", None, 5)]
    df = spark.createDataFrame(rows, "id int, s string, f string, v string, n int").withColumn("v_filled", F.lit("clash"))
    targets = [impute.Target("v", [["s"], ["f"]]), impute.Target("n", [["s"], ["f"]], kind="median")]
    got = impute.group_fill(df, targets)
    assert got.count() == 10
    by = {r.id: r for r in got.collect()}
    assert (by[2].v, by[2].v_filled, by[2].v_level) == ("x", True, 0)
    assert by[5].v is None and by[5].v_filled is False  # ties on both levels
    assert (by[5].n, by[5].n_level, by[2].n) == (3, 0, 1)
    assert by[6].v is None and by[6].v_level is None
    assert by[9].v is None and by[1].v_filled is False
    assert impute.group_fill(df.limit(0), targets).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes(b"\xef\xbb\xbfrank,common_name,scientific_name,taxon_id,observations_count,iconic_taxon,rank_level\n1,a,b,007,3,Plantae,species\n")
    assert files.read_species(spark, str(tmp_path / "s.csv")).first().taxon_id == "007"
    with pytest.raises(ValueError, match="taxon_id"):
        files.require_columns(spark.range(1), ["taxon_id"])
    with pytest.raises(FileNotFoundError):
        files.read_index(spark, str(tmp_path / "none"))
    index = spark.createDataFrame([("k", [1.0])], "kingdom string, embedding array<float>")
    files.write_index(index, str(tmp_path / "ix"))
    assert files.read_index(spark, str(tmp_path / "ix")).count() == 1
    for name in ("1_a b/x.JPG", "1_a b/y.webp", "1_a b/z.gif", "2_c/x.jpg"):
        p = tmp_path / "img" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    known = spark.createDataFrame([("1",)], "taxon_id string")
    assert sorted(values(files.scan_images(spark, str(tmp_path / "img"), known), "file")) == ["x.JPG", "y.webp"]
    assert values(files.scan_images(spark, str(tmp_path / "img"), known, n=1), "file") == ["x.JPG"]
    (tmp_path / "g.json").write_text('{"features":[{"geometry":{"type":"Polygon","coordinates":[[[1,2]]]},"properties":{"LEVEL3_COD":"A","LEVEL3_NAM":"a"}}]}')
    assert "Polygon" in files.read_features(spark, str(tmp_path / "g.json")).first().geometry
    np.save(tmp_path / "m.npy", np.arange(15, dtype=np.float32).reshape(3, 5))
    names = spark.createDataFrame([(k, [str(k)], "c") for k in range(5)], "pos int, ranks array<string>, common string")
    got = {r.pos: (r.ranks, list(r.embedding)) for r in files.import_matrix(spark, str(tmp_path / "m.npy"), names, 2).collect()}
    assert got == {k: ([str(k)], [k, k + 5, k + 10]) for k in range(5)}
    with pytest.raises(ValueError):
        files.import_matrix(spark, str(tmp_path / "m.npy"), names.limit(4))
    files.write_csv(names.select("pos", "common").coalesce(1), str(tmp_path / "c"), ["common", "pos"])
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfcommon,pos")
    (tmp_path / "d.json").write_text('{"id":"1","taxonRemarks":"o","lifeform":"tree","climate":"wet","distribution":{"natives":[{"tdwgCode":"A"},{"tdwgCode":"B"}]}}\n{"id":"2"}')
    native = files.read_distribution(spark, str(tmp_path / "d.json"))
    assert sorted((r.id, r.code, r.climate) for r in native.collect() if r.code) == [("1", "A", "wet"), ("1", "B", "wet")] and native.filter("id = '2' and code is null").count() == 1
    features = spark.createDataFrame([("{}", "A", "a"), ("{}", "C", "c")], "geometry string, code string, name string")
    plants = spark.createDataFrame([("Acer", "1"), ("Rosa", "2")], "name string, id string")
    rows, page = regions.native_range(plants, native, features, " Acer ", str(tmp_path))
    assert rows.count() == 1 and "tree" in page and "not native" in page and (tmp_path / "Acer_native.html").exists()
    assert regions.native_range(plants, native, features, "Rosa") is None and regions.native_range(plants, native, features, "Abies") is None


@pytest.fixture(scope="module")
def api():
    """A stub of a paged service: 25 rows, taxa by id, photos of a class, one class that fails."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlsplit

    class Stub(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(at.query).items()}
            status, body = 200, b"x" * 70_000
            if at.path == "/rows":
                size, page = int(q["per_page"]), int(q["page"])
                rows = [{"n": k, "place": q.get("place")} for k in range(25)][(page - 1) * size : page * size]
                body = json.dumps({"total_results": 25, "results": rows}).encode()
            elif at.path.startswith("/taxa/"):
                body = json.dumps({"results": [{"id": int(i), "rank": "genus", "name": f"n{i}", "ancestor_ids": [1, int(i)]} for i in at.path[6:].split(",") if i != "9"]}).encode()
            elif at.path == "/obs":
                status = 404 if q["taxon_id"] == "5" else 200
                host = f"http://{self.headers['Host']}"
                body = json.dumps({"results": [{"id": k, "photos": [{"id": 1, "url": f"{host}/p/{k}/square.jpg"}, {"id": 2, "url": None}]} for k in range(int(q["per_page"]))]}).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rest(spark, api, tmp_path):
    import io
    import urllib.error

    waits, calls = [], []

    def busy():
        calls.append(1)
        raise urllib.error.HTTPError("u", 429, "busy", {}, io.BytesIO())

    assert rest.Retry(3, sleep=waits.append).run(busy) is None and waits == [60.0, 120.0] and len(calls) == 3
    reader = rest.PagedReader({"url": f"{api}/rows?a=b", "per_page": "10", "param.place": "6"})
    assert [p.value for p in reader.partitions()] == [(1, 10), (2, 10), (3, 5)]
    assert [r for p in reader.partitions() for r in reader.read(p)][24] == (3, '{"n": 24, "place": "6"}')
    cut = rest.PagedReader({"url": f"{api}/rows", "per_page": "10", "most": "12"})
    assert sum(len(list(cut.read(p))) for p in cut.partitions()) == 12
    long = rest.PagedReader({"url": f"{api}/rows", "per_page": "10", "total": "40"})  # more announced than there is
    assert sum(len(list(long.read(p))) for p in long.partitions()) == 25
    spark.dataSource.register(rest.PagedSource)
    assert spark.read.format("paged_rest").option("url", f"{api}/rows").option("per_page", "10").load().count() == 25
    assert rest.download(f"{api}/p", str(tmp_path / "f")) and (tmp_path / "f").stat().st_size == 70_000
    assert rest.cached_file("http://127.0.0.1:9/none", str(tmp_path / "f")) == str(tmp_path / "f")
    ids = spark.createDataFrame([(k,) for k in range(1, 40)] + [(None,), (3,)], "t bigint")
    taxa = rest.lookup_taxa(ids, "t", f"{api}/taxa", 30).collect()
    assert len(taxa) == 38 and {r.id: r.ancestor_ids for r in taxa}["7"] == ["1", "7"]
    how = rest.Photos(f"{api}/obs", str(tmp_path / "tree"))
    classes = spark.createDataFrame([("4", "Acer: x", 3), ("5", "Rosa", 2), (None, "n", 1)], "taxon_id string, sci_name string, need int")
    for again in (False, True):
        got = {r.taxon_id: (r.downloaded, r.skipped) for r in rest.store_photos(classes, how).collect()}
        assert got == {"4": (0, 3) if again else (3, 0), "5": (0, 0)}
    assert sorted(p.name for p in (tmp_path / "tree" / "4_Acer_ x").iterdir()) == ["0_1.jpg", "1_1.jpg", "2_1.jpg"]


def png(rgb):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, _ = rgb.shape
    lines, above = b"", np.zeros(w * 3, np.uint8)
    for y in range(h):  # the five filters in turn
        line, kind = rgb[y].ravel(), y % 5
        left = np.concatenate([np.zeros(3, np.uint8), line[:-3]]).astype(int)
        corner = np.concatenate([np.zeros(3, np.uint8), above[:-3]]).astype(int)
        up = above.astype(int)
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (0 * left, left, up, (left + up) // 2, paeth)[kind]
        lines += bytes([kind]) + ((line.astype(int) - guess) % 256).astype(np.uint8).tobytes()
        above = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    from phytomill.functions import encoder, images

    rgb = np.random.default_rng(0).integers(0, 256, size=(11, 17, 3)).astype(np.uint8)
    assert (images.decode(png(rgb)) == rgb).all()
    assert images.decode(b"no image") is None and images.decode(None) is None and images.decode(png(rgb)[:50]) is None
    flat = images.preprocess(np.full((30, 50, 3), 255, np.uint8))
    assert flat.shape == (3, 224, 224) and np.allclose(flat[0], (1 - images.MEAN[0]) / images.DEVIATION[0], atol=1e-5)
    (tmp_path / "a.png").write_bytes(png(rgb))
    with pytest.raises(FileNotFoundError):
        images.load(str(tmp_path / "none.png"))
    make = encoder.PixelEncoder
    index = spark.createDataFrame([(1, "Acer", make().encode([png(rgb)])[0]), (2, "Rosa", make().encode([png(255 - rgb)])[0])], "vec_id bigint, scientific_name string, embedding array<float>")
    found = service.identify_image(index, str(tmp_path / "a.png"), "vec_id", 2)
    assert [r["scientific_name"] for r in found] == ["Acer", "Rosa"] and found[0]["similarity"] == 1.0
    statuses = [service.predict(i, b, "vec_id", k, make)[0] for i, b, k in ((None, png(rgb), 5), (index, b"no", 5), (index, None, 5), (index, png(rgb), 0), (index, png(rgb), 1))]
    assert statuses == [503, 400, 400, 422, 200]
    assert service.health_record(index)["species_count"] == 2 and service.health_record(None)["status"] == "loading"
    assert encoder.resolve([str(tmp_path / "x"), str(tmp_path / "a.png")]) == str(tmp_path / "a.png") and encoder.resolve([], lambda: "hub") == "hub"
    assert encoder.token_ids("A  b", lambda t: [len(t)], 1, 2, 6) == [1, 3, 2, 0, 0, 0] and len(encoder.token_ids("x", lambda t: [5] * 200, 1, 2)) == 77


def test_service_and_stream(spark, tmp_path):
    import base64

    from phytomill.functions.encoder import HashEncoder
    from phytomill.streaming.scoring import score_stream

    image = b"leaf picture"
    index = spark.createDataFrame([(1, "Acer", "nan", HashEncoder().encode([image])[0])], "vec_id bigint, scientific_name string, common_name string, embedding array<float>")
    coded = base64.b64encode(image).decode()
    requests = spark.createDataFrame([("a", coded), ("b", ""), ("c", None)], "request_id string, image string")
    got = {r.request_id: r for r in service.identify(index, requests, "vec_id").collect()}
    assert '"similarity":1.0' in got["a"].results and '"common_name":null' in got["a"].results
    assert got["b"].error == got["c"].error == "missing image"
    with pytest.raises(ValueError):
        service.checked_k(21)
    asked = index.select(F.lit(5).cast("bigint").alias("query_id"), "embedding")
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, index.select("vec_id", "embedding"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().vec_id == 1


def test_median_is_exact_beyond_ten_thousand_values(spark):
    rng = np.random.default_rng(9)
    values = sorted({int(v) for v in rng.exponential(1e7, size=200_001)})
    df = spark.createDataFrame([("a", v) for v in values[::-1]], "s string, n bigint")
    df = df.repartition(5).union(spark.createDataFrame([("a", None)], "s string, n bigint"))
    got = impute.group_fill(df, [impute.Target("n", [["s"]], kind="median")])
    assert got.filter("n_filled").first().n == values[(len(values) - 1) // 2]
