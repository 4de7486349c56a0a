import io
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import notes as notes_
from quire.operators import clips, raster, transfer, typeset
from quire.sources import catalog, scan, word
from quire.streaming import imports


def png(path, grey):
    h, w = grey.shape
    raw = b"".join(b"\0" + row.tobytes() for row in grey.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_files_are_routed_and_streamed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# A")
    (src / "b.txt").write_text("no")
    good, bad = scan.read_files(spark, str(src))
    assert [r.sourcetype for r in good.collect()] == ["md"] and "b.txt" in bad.first().message
    run = lambda: imports.write_imports(imports.import_stream(spark, str(src)), f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    run()
    (src / "c.html").write_text("<p>")
    run()
    assert sorted(r.title for r in spark.read.parquet(f"{tmp_path}/ok").collect()) == ["a", "c"] and spark.read.parquet(f"{tmp_path}/bad").count() == 1
    assert scan.read_markdown(spark, str(src / "a.md")).first().text == "# A"


def test_job_states_are_final(spark, tmp_path):
    spark.createDataFrame([(1, "queued"), (1, "done"), (2, "running")], "id long, status string").coalesce(1).write.parquet(f"{tmp_path}/e")
    events = lambda: spark.readStream.schema("id long, status string").parquet(f"{tmp_path}/e")

    def run():
        def keep(rows, epoch):
            rows.write.mode("append").parquet(f"{tmp_path}/out/{epoch}")

        imports.job_states(events()).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([(1, "running"), (2, "failed")], "id long, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    run()
    last = max(os.listdir(f"{tmp_path}/out"), key=int)
    assert {r.id: r.status for r in spark.read.parquet(f"{tmp_path}/out/{last}").collect()} == {1: "done", 2: "failed"}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    files = spark.createDataFrame([("a.md", 3), ("b.xyz", 4)], "path string, length long")
    batch = imports.imports_batch(f"{tmp_path}/ok", f"{tmp_path}/bad")
    batch(files, 0)
    batch(files.withColumn("path", F.concat(F.lit("x"), "path")), 1)
    first = [sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{x}").collect())) for x in ("ok", "bad")]
    for epoch in (1, 1):
        batch(files.withColumn("path", F.concat(F.lit("x"), "path")), epoch)
    assert first == [sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{x}").collect())) for x in ("ok", "bad")] and [len(x) for x in first] == [2, 2]


def test_reflow_replaces_staged_pages(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, "<p>a</p>"), (1, 1, "<p>b</p>"), (2, 0, "<p>c</p>")], "sourceid long, block_index int, html string").selectExpr("*", "'text' kind", "'p' tag")
    hidden: list = []

    def reflow(ids):
        mine = blocks.join(ids, "sourceid", "left_semi")
        left = typeset.shown_blocks(mine, spark.createDataFrame(hidden, "sourceid long, block_index int"), spark.createDataFrame([], "sourceid long, block_index int"), "sourceid")
        return typeset.typeset(left, "sourceid").select("sourceid", "block_index", "page_no")

    batch = imports.reflow_batch(reflow, str(tmp_path))
    change = lambda *ids: spark.createDataFrame([(i,) for i in ids], "sourceid long")
    seen = lambda: sorted(map(tuple, imports.staged_pages(spark, str(tmp_path)).collect()))
    batch(change(1, 2, None), 0)
    assert seen() == [(1, 0, 1), (1, 1, 1), (2, 0, 1)]
    hidden.append((1, 0))
    for _ in range(2):
        batch(change(1, 1), 1)
        assert seen() == [(1, 1, 1), (2, 0, 1)]
    hidden.append((2, 0))
    batch(change(2), 2)
    assert seen() == [(1, 1, 1)]
    imports.reflow_batch(lambda ids: reflow(ids).where("false"), f"{tmp_path}/none")(change(1), 0)
    assert imports.staged_pages(spark, f"{tmp_path}/none", "sourceid long, block_index long, page_no int").count() == 0
    src = tmp_path / "changes"
    change(1).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("sourceid long").parquet(str(src))
    imports.incremental_reflow(stream, reflow, f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, imports.staged_pages(spark, f"{tmp_path}/t").collect())) == [(1, 1, 1)]


def test_jobs_are_watched_by_timers(spark, tmp_path):
    import datetime

    day, start = datetime.timedelta(days=1), datetime.datetime(2024, 5, 1, 12)
    at = lambda minutes: start + datetime.timedelta(minutes=minutes)
    schema = "id long, status string, ts timestamp"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        before = set(seen())
        keep = lambda r, epoch: r.write.mode("overwrite").parquet(f"{tmp_path}/out/{epoch}")
        imports.job_watch(spark.readStream.schema(schema).parquet(f"{tmp_path}/e")).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return set(seen()) - before

    def seen():
        return [tuple(r) for d in (os.listdir(f"{tmp_path}/out") if os.path.isdir(f"{tmp_path}/out") else ()) for r in spark.read.parquet(f"{tmp_path}/out/{d}").collect()]

    assert run((1, "queued", at(0)), (2, "queued", at(0)), (2, "running", at(1)), (3, "done", at(2)), (None, "done", at(0)), (4, "odd", at(0))) == {(1, "queued", at(0)), (2, "queued", at(0)), (2, "running", at(1)), (3, "done", at(2))}
    # a running job can't be dismissed, a finished one can; job 1 waits for over ten minutes
    assert run((2, "dismiss", at(3)), (3, "dismiss", at(4)), (3, "running", at(3)), (9, "queued", at(40))) == {(3, "dismissed", at(4)), (9, "queued", at(40)), (1, "stale", at(10))}
    assert run((1, "failed", at(50)), (1, "running", at(51)), (9, "done", at(52))) == {(1, "failed", at(50)), (9, "done", at(52))}
    assert run((5, "queued", at(60) + day)) >= {(5, "queued", at(60) + day)}
    late = run((6, "queued", at(200) + day))
    assert {(1, "forgotten", at(50) + day), (9, "forgotten", at(52) + day)} <= set(seen()) and (2, "stale", at(10)) not in seen() and late


def test_views(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'view'").select("user_id", (F.col("event_id") % 40).alias("documentid"), "ts")
    v.coalesce(1).write.parquet(f"{tmp_path}/v")
    s = spark.readStream.schema(v.schema).parquet(f"{tmp_path}/v")
    q = imports.first_views(s, "60 days").writeStream.format("memory").queryName("first_views").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_views").count() == v.select("user_id", "documentid").distinct().count()
    q = imports.view_counts(s).writeStream.format("memory").queryName("view_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("view_counts").agg(F.sum("views")).first()[0] == v.count()


def test_archives_and_word(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"""<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>one</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>next</w:t></w:r><w:r><w:footnoteReference w:id="7"/></w:r></w:p></w:body></w:document>"""
    files = spark.createDataFrame([("z.zip", bytearray(zipped(**{"page10.png": b"b", "page2.png": b"a", "__MACOSX/x.png": b"", "t.txt": b""}))), ("d.docx", bytearray(zipped(**{"word/document.xml": xml}))), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    assert [r.entry for r in scan.archive_images(files).where("path = 'z.zip'").orderBy("page_no").collect()] == ["page2.png", "page10.png"]
    runs = scan.docx_runs(files)
    p = scan.docx_paragraphs(runs).orderBy("paragraph").collect()
    assert [(r.text, r.segment, r.list_run) for r in p] == [("Head", 0, None), ("one", 0, 1), ("two", 0, 1), ("next", 0, None)]
    assert [(r.footnote, r.number) for r in scan.docx_footnotes(runs).collect()] == [("7", 1)]


def test_archives_are_read_within_bounds(spark):
    pages = {f"Seite {i}.PNG": b"p%d" % i for i in range(400, 0, -1)} | {"dir/a.jpg": b"sub", "__MACOSX/Seite 1.png": b"", "sub/__MACOSX/x.png": b"", "note.txt": b"t"}
    broken = bytearray(zipped(**{"a.png": b"A" * 40, "b.png": b"B" * 40}))
    at = broken.index(b"A" * 40)
    broken[at] = 7
    files = spark.createDataFrame([("good", bytearray(zipped(**pages))), ("broken", broken), ("none", None), ("text", bytearray(b"x" * 99)), ("empty", bytearray(zipped()))], "path string, content binary")
    rows = scan.archive_images(files).collect()
    good = sorted((r for r in rows if r.path == "good"), key=lambda r: r.page_no)
    assert [r.entry for r in good] == ["dir/a.jpg", *[f"Seite {i}.PNG" for i in range(1, 300)]] and bytes(good[12].data) == b"p12" and [r.page_no for r in good] == list(range(1, 301))
    assert [(r.page_no, r.entry, r.data is None, r.message is None) for r in sorted((r for r in rows if r.path == "broken"), key=lambda r: r.page_no)] == [(1, "a.png", True, False), (2, "b.png", False, True)]
    assert {(r.path, r.page_no, r.message is None) for r in rows if r.path not in ("good", "broken")} == {("none", None, False), ("text", None, False)}


def test_word_parts(spark):
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    cell = lambda inner: f"<w:tc>{inner}</w:tc>"
    deep = f"<w:tbl><w:tr>{cell('<w:p>' + run('d1') + '</w:p><w:tbl><w:tr>' + cell('<w:p>' + run('d2') + '</w:p>') + '</w:tr></w:tbl>')}{cell('<w:p>' + run('d3') + '</w:p>')}</w:tr></w:tbl>"
    body = f"""<w:p><w:pPr><w:pStyle w:val="berschrift4"/></w:pPr>{run('A &amp; &lt;b>')}</w:p><w:p><w:pPr><w:numPr/></w:pPr>{run('i')}</w:p><w:tbl><w:tr>{cell('<w:p>' + run('x') + '</w:p>' + deep + '<w:p>' + run('y') + '</w:p>')}</w:tr></w:tbl>
<w:p><w:pPr><w:numPr/></w:pPr>{run('j')}<w:r><w:br w:type="page"/></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr>{run('k')}</w:p><w:p/><w:p><w:r><w:footnoteReference w:id="5"/></w:r><w:r><w:rPr><w:b/><w:i/></w:rPr><w:t>s</w:t><w:footnoteReference w:id="2"/></w:r><w:r><w:footnoteReference w:id="5"/></w:r>
<w:r><a:blip r:embed="r1"/><a:blip r:embed="r2"/><a:blip r:embed="r3"/></w:r></w:p>"""
    notes = f'<w:footnotes {names}><w:footnote w:id="1"><w:p>{run("unused")}</w:p></w:footnote><w:footnote w:id="2"><w:p>{run("two")}</w:p><w:p>{run("more")}</w:p></w:footnote><w:footnote w:id="5"><w:p>{run("five")}</w:p></w:footnote></w:footnotes>'
    links = '<R><Relationship Id="r1" Target="media/a.png"/><Relationship Id="r2" Target="media/gone.png"/><Relationship Id="r3" Target="http://x"/></R>'
    full = zipped(**{"word/document.xml": f"<w:document {names}><w:body>{body}</w:body></w:document>", "word/footnotes.xml": notes, "word/_rels/document.xml.rels": links, "word/media/a.png": b"A", "word/media/unused.png": b"U"})
    files = spark.createDataFrame([("w", bytearray(full)), ("zip", bytearray(zipped(**{"x": b""}))), ("bad", bytearray(b"no")), ("none", None), ("bare", bytearray(zipped(**{"word/document.xml": f"<w:document {names}/>"})))], "path string, content binary")
    parts = word.word_parts(files.repartition(3))
    mark = lambda n: f'<sup><a href="#fn:{n}" class="footnote-ref">{n}</a></sup>'
    assert [(r.path, r.page_no, r.html) for r in word.word_pages(parts).orderBy("page_no").collect()] == [
        ("w", 1, "<h4>A &amp; &lt;b&gt;</h4><ul><li>i</li></ul><table><tr><td>x<br>d1<br>d2<br>d3<br>y</td></tr></table><ul><li>j</li></ul>"),
        ("w", 2, f'<ul><li>k</li></ul><p>{mark(1)}<em><strong>s{mark(2)}</strong></em>{mark(1)}<img src="docx:word/media/a.png" alt=""></p><div class="footnotes"><hr><ol><li id="fn:1"><p>five</p></li><li id="fn:2"><p>two</p><p>more</p></li></ol></div>'),
    ]
    assert [(r.id, r.src, r.filename, bytes(r.data)) for r in word.word_media(parts).collect()] == [("r1", "docx:word/media/a.png", "a.png", b"A")]
    assert [(r.id, r.number) for r in word.word_notes(parts).orderBy("number").collect()] == [("5", 1), ("2", 2)]
    assert {r.path for r in parts.where("part = 'error'").collect()} == {"zip", "bad", "none"} and parts.agg(F.max("depth")).first()[0] == 3
    made = notes_.noted_blocks(word.word_pages(parts).where("page_no = 2").select("path", "html"), "path").orderBy("block_index").collect()
    assert [(r.kind, len(r.notes)) for r in made] == [("text", 0), ("text", 3), ("image", 0)]


def test_media(spark):
    d = spark.createDataFrame([("audio/ogg", bytearray(b"x" * 5)), ("text/plain", bytearray(b"x")), ("image/png", bytearray(b"x" * 50)), (None, bytearray())], "mimetype string, content binary")
    good, bad = scan.media_checked(d, 10)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["size", "type", "type"]
    b = spark.createDataFrame([("data:image/png;base64,aGk=",), ("data:image/png;base64,%%",), (None,)], "src string")
    assert [bytes(r.data) if r.data else None for r in scan.inline_images(b).collect()] == [b"hi", None, None]


def test_catalog_fills_defaults(spark):
    d = catalog.with_defaults(spark.createDataFrame([(1, None)], "id long, filler boolean"), "page")
    r = d.first()
    assert r.filler is False and r.pagetype == "image" and r.spreadid is None


def pixels(spark, tmp_path, grey):
    png(tmp_path / "p.png", grey)
    image = scan.read_page_images(spark, str(tmp_path)).first()
    a = np.frombuffer(bytes(image.data), np.uint8).reshape(image.height, image.width, image.channels)[..., 0]
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    return spark.createDataFrame([(1, int(i), int(j), int(v)) for i, j, v in zip(x.ravel(), y.ravel(), a.ravel())], "page int, x int, y int, lum int")


def test_page_decisions(spark, tmp_path):
    grey = np.full((60, 200), 255)
    grey[5:55, 10:90] = 0
    grey[5:55, 112:190] = 0
    d = pixels(spark, tmp_path, grey)
    profile = raster.column_profile(d)
    assert raster.empty_band(profile.select("page", "x", "ink")).first().center == 100
    assert [(r.first, r.last) for r in raster.text_columns(profile.select("page", "x", "ink")).orderBy("column_no").collect()] == [(10, 89), (112, 189)]
    bg = raster.tile_background(d, 20)
    flat = raster.without_shadow(d.where("lum = 255"), bg, 20).agg(F.max("lum"), F.count("*")).first()
    assert flat[0] == 255 and flat[1] == int((grey == 255).sum())
    masks = spark.createDataFrame([(1, 0, 0, 70, 3)], "page int, x0 int, y0 int, x1 int, y1 int")
    assert raster.covered_pixels(d, masks).count() == 210


def test_shadow_is_bilinear(spark):
    rng = np.random.default_rng(4)
    size, (h, w) = 16, (70, 45)
    lum = rng.integers(30, 256, (h, w))
    y, x = np.mgrid[:h, :w]
    rows = [(3, int(i), int(j), int(v)) for i, j, v in zip(x.ravel(), y.ravel(), lum.ravel())]
    d = spark.createDataFrame(rows, "page int, x int, y int, lum int").repartition(4)
    bg = raster.tile_background(d, size)
    tiles = np.zeros((-(-h // size), -(-w // size)))
    for ty in range(tiles.shape[0]):
        for tx in range(tiles.shape[1]):
            part = np.sort(lum[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size].ravel())
            tiles[ty, tx] = max(40, part[min(int(0.9 * len(part)), len(part) - 1)])
    got = {(r.x, r.y): r.lum for r in raster.without_shadow(d, bg, size).collect()}
    assert len(got) == h * w
    at = lambda ty, tx: tiles[min(max(ty, 0), tiles.shape[0] - 1), min(max(tx, 0), tiles.shape[1] - 1)]
    for (i, j), v in got.items():
        fx, fy = i / size - 0.5, j / size - 0.5
        x0, y0 = int(np.floor(fx)), int(np.floor(fy))
        u, t = fx - x0, fy - y0
        b = (at(y0, x0) * (1 - u) + at(y0, x0 + 1) * u) * (1 - t) + (at(y0 + 1, x0) * (1 - u) + at(y0 + 1, x0 + 1) * u) * t
        assert abs(v - min(255, int(np.floor(lum[j, i] * 255 / b)))) <= (1 if abs(lum[j, i] * 255 / b % 1) > 0.999999 or abs(lum[j, i] * 255 / b % 1) < 1e-6 else 0)


@pytest.mark.parametrize("angle", [-3.5, -1.25, 0.75, 3.0])
def test_skew(spark, angle):
    rows = [(1, x, int(round(60 + 31 * k + x * np.tan(np.radians(angle))))) for k in range(3) for x in range(0, 400, 2)]
    found = raster.skew(spark.createDataFrame(rows, "page int, x int, y int")).first().angle
    assert abs(found - angle) <= 0.25
    assert raster.skew(spark.createDataFrame(rows[:20], "page int, x int, y int")).first().angle == 0


def test_remapping(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, sourceid long")
    new = spark.createDataFrame([(5, 50)], "old long, new long")
    assert sorted((r.id, r.sourceid) for r in transfer.remapped(rows, "sourceid", new).collect()) == [(1, 50), (2, None), (3, None)]


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_contract(spark, name):
    import __spark_entry__ as e

    if name == "entry":
        assert e.entry(spark).columns
    else:
        assert set(e.oracle_sql()) <= set(e.queries())


def test_rows_without_shadow_are_their_pixels(spark):
    """Rows of pixels give what the pixels give, ragged pages and tiles without pixels included, and go through one shuffle."""
    rng = np.random.default_rng(6)
    rows = [(page, y, rng.integers(20, 256, int(rng.integers(0, 60))).tolist()) for page in range(6) for y in range(int(rng.integers(1, 50))) if rng.random() < 0.7]
    d = spark.createDataFrame(rows, "page long, y long, lum array<int>").repartition(3)
    pixels = d.select("page", F.posexplode("lum").alias("x", "lum"), "y").select("page", F.col("x").cast("long").alias("x"), "y", "lum")
    want = sorted(tuple(r) for r in raster.without_shadow(pixels, raster.tile_background(pixels, 8), 8).select("page", "x", "y", "lum").collect())
    flat = raster.rows_without_shadow(d, 8, 500)
    assert sorted((r.page, x, r.y, v) for r in flat.collect() for x, v in enumerate(r.lum)) == want
    assert flat._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_mean_luminance_shuffles_no_pixels(spark):
    rng = np.random.default_rng(7)
    rows = [(page, x, y, int(rng.integers(0, 256))) for page, (w, h) in enumerate([(1, 1), (320, 4), (7, 301)]) for x in range(w) for y in range(h)]
    d = spark.createDataFrame(rows, "page long, x long, y long, lum int")
    sized = d.join(d.groupBy("page").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")), "page")
    want, got = clips.mean_luminance(d), clips.mean_luminance(sized.localCheckpoint())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 0
