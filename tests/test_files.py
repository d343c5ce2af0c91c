"""Prediction files, layout evaluation from files, reports as written elsewhere, notes and document scores."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import jsontext as J
from quire.functions import metrics as M
from quire.functions import models
from quire.functions import normalize as N
from quire.functions import segment as S
from quire.operators import align, layout, runs, solvers, strata
from quire.plans import registry
from quire.sources import manifest, predictions, reports
from quire.streaming import follow
from tests.conftest import rows


def test_guessed_texts():
    """Answers written out by hand."""
    for value, want in [
        ({"text": "a", "full_text": "b"}, "b"), ({"ocr_text": "z"}, "z"), ([{"text": " a "}, {"x": 1}], "a"), ([{"text": " "}, {"rec_text": "l1", "text": "no"}, "string"], "l1"),
        (["only"], "only"), ([["deep"]], "deep"), (["a", "b"], None), ({"result": {"document": {"md": "m"}}}, "m"), ({"text": "  ", "markdown": "x"}, "x"), ({"text": 3}, None), ("  ", None), ({}, None), ([], None),
        ({"pages": [{"text": "p"}]}, None), ({"output": [{"txt": "t1"}, {"content": "t2"}]}, "t1\nt2"),
    ]:
        assert J.guess(value) == want, value


def test_prediction_files_by_their_names():
    lines = json.dumps({"res": [{"rec_texts": []}, {"rec_texts": ["l1", "l2"], "rec_boxes": [[0, 0, 2, 1], [0, 1, 2, 2]]}]})
    assert J.file_text("PaddleOCR_predict.json", lines) == "l1\nl2"
    assert J.lines_and_boxes(lines) == (["l1", "l2"], [[0, 0, 2, 1], [0, 1, 2, 2]])
    doc = {"body": {"children": [{"$ref": "#/texts/1"}, {"text": "not a reference", "label": "text"}, {"$ref": "#/texts/0"}, {"$ref": "#/none/0"}]}, "texts": [{"text": "a", "label": "text"}, {"text": " b ", "label": "caption", "children": [{"$ref": "#/texts/2"}]}, {"orig": "c", "label": "text"}]}
    assert J.file_text("docling_document.json", json.dumps(doc)) == "b\na"
    assert J.file_text("x.md", '{"text": 1}') == '{"text": 1}' and J.file_text("x.json", '{"text": "t"}') == "t" and J.file_text("x.json", '{"text": "t"}', form="text") == '{"text": "t"}'
    assert J.file_text("x.json", '{"a": [{"b": "v"}]}', key="a.0.b") == "v" and J.file_text("x.json", '{"a": {"md": "v"}}', key="a") == "v"
    for name, raw, more in [("x.json", "{}", {}), ("x.json", "nope", {}), ("x.json", '{"a": 1}', {"key": "a"}), ("x.json", '{"a": 1}', {"key": "b"}), ("docling_document.json", "[]", {}), ("paddleocr_predict.json", "{}", {})]:
        with pytest.raises((ValueError, KeyError)):
            J.file_text(name, raw, **more)


def test_large_recognizer_files_are_read_from_their_end(monkeypatch):
    raw = json.dumps({"img": [0] * 500, "rec_texts": ["x", "y"], "rec_boxes": [[0, 0, 1, 1], [1, 1, 2, 2]]})
    monkeypatch.setattr(J, "LARGE", 100)
    monkeypatch.setattr(J, "TAIL", 120)
    assert J.file_text("paddleocr_predict.json", raw) == "x\ny" and J.lines_and_boxes(raw)[1] == [[0, 0, 1, 1], [1, 1, 2, 2]]
    with pytest.raises(ValueError):
        J.file_text("paddleocr_predict.json", raw, key="rec_texts")
    with pytest.raises(ValueError):
        J.lines_of_file("[" + "0," * 200 + "0]")


def test_folder_of_predictions(spark, tmp_path):
    (tmp_path / "1.md").write_text("# one")
    (tmp_path / "2.json").write_text('{"ocr_text": "two"}')
    (tmp_path / "3.json").write_text("{")
    got = {r["task_id"]: r for r in rows(predictions.page_texts(spark, str(tmp_path)))}
    assert got["1"]["text"] == "# one" and got["2"]["text"] == "two" and got["3"]["text"] is None and got["3"]["error"] and not got["1"]["error"]
    there = spark.createDataFrame([("/d/p1.png",), ("/i/00.jpg",), ("/i/b.png",)], "path string")
    wanted = spark.createDataFrame([("1", "d/p1.png"), ("2", "/up/12/ab-00.jpg"), ("3", "x/b.png"), ("4", "none.png"), ("5", " ")], "task_id string, image string")
    assert {r["task_id"]: r["found"] for r in rows(predictions.page_images(wanted, there, "/", "/i"))} == {"1": "/d/p1.png", "2": "/i/00.jpg", "3": "/i/b.png", "4": None, "5": None}
    (tmp_path / "img").mkdir()
    for name in ("b.png", "a.JPG", "no.txt"):
        (tmp_path / "img" / name).write_bytes(name.encode())
    assert [(r["page_index"], bytes(r["content"])) for r in rows(predictions.images(spark, str(tmp_path / "img")).orderBy("page_index"))] == [(0, b"a.JPG"), (1, b"b.png")]


def test_layout_from_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"rec_texts": ["left", "right", "below"], "rec_boxes": [[0, 0, 40, 10], [60, 0, 100, 10], [0, 90, 100, 100]]}))
    pages = predictions.recognizer_pages(spark, str(tmp_path)).select(F.lit("1").alias("task_id"), "rec_texts", "rec_boxes")
    box = "struct<x:double,y:double,width:double,height:double,rotation:double>"
    regions = spark.createDataFrame([("1", 0, "r0", (0.0, 0.0, 100.0, 12.0, 0.0), "left right"), ("1", 1, "r1", None, "gone"), ("1", 2, "r2", (0.0, 40.0, 5.0, 5.0, 0.0), "nothing there")], f"task_id string, gt_index int, region_id string, bbox {box}, gt_raw string")
    got = {r["gt_index"]: r for r in rows(layout.align_recognizer_files(regions, pages))}
    assert (got[0]["pred_raw"], got[0]["ned"], got[0]["pred_indices"]) == ("left right", 0, [0, 1])
    assert got[1]["ned"] == 1 and got[2]["pred_raw"] == ""
    docs = predictions.lines_as_layout(pages)
    assert {r["gt_index"]: r["ned"] for r in rows(layout.align_layout_files(regions.filter("gt_index = 0"), docs))} == {0: 0}
    assert all(r["ned"] == 0 for r in rows(layout.align_documents(docs, docs)))
    b = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("l", -10), ("t", 120), ("r", 50), ("b", 20))))
    r = spark.range(1).select(G.from_document(b, F.lit(100.0), F.lit(100.0)).alias("b")).first().b
    assert tuple(r) == (-0.1, -0.2, 0.5, 0.8)  # upwards, and not cut to the page


def test_region_types_and_texts():
    line = lambda t: f"<TextLine><Word><TextEquiv><Unicode>{t}x</Unicode></TextEquiv></Word><TextEquiv><Unicode> {t} </Unicode></TextEquiv></TextLine>"
    region = lambda kind, inner: f'<TextRegion custom="structure {{type:{kind};}}"><Coords points="0,0 10,10"/>{inner}</TextRegion>'
    kinds = {"text": "paragraph", "table": "table_cell", "Table Cell": "table_cell", "form": "form_field", "handwritten": "handwritten", "heading": "paragraph", "footer": "footer"}
    xml = "<P><Page imageWidth='100' imageHeight='100'>" + "".join(region(k, line("a") + f"<Sub>{line('b')}</Sub>") for k in kinds) + "</Page></P>"
    got = manifest.page_regions(xml)
    assert [r["region_type"] for r in got] == list(kinds.values()) and all(r["text"] == "a\nb" for r in got)
    with pytest.raises(ValueError):
        manifest.page_regions("<P/>")


def test_reports_of_any_layout_of_json(spark, tmp_path):
    one = lambda t: {"task_id": t, "model_name": "m", "alignment": "text", "match_mode": "quick", "notes": ["n"], "matches": [{"gt_index": 0, "region_id": "r", "ned": 0.5, "gt_norm": "a", "pred_norm": "b"}, {}]}
    (tmp_path / "a.json").write_text(json.dumps(one("1"), indent=2))
    (tmp_path / "b.json").write_text(json.dumps(one("2")) + "\n" + json.dumps(one("3")) + "\n")
    (tmp_path / "c.json").write_text(json.dumps([one("4"), one("5")], indent=1))
    (tmp_path / "d.json").write_text("{nope")
    (tmp_path / "e.json").write_text(json.dumps(one(None)))
    got = sorted((r["task_id"], r["gt_index"], r["ned"]) for r in rows(reports.read_alignments(spark, str(tmp_path))))
    assert got == sorted((str(k), *x) for k in range(1, 6) for x in ((0, 0.5), (-1, 0.0)))


def test_whole_reports(spark, tmp_path):
    regions = spark.createDataFrame([("1", 0, "r0", "some text here"), ("1", 1, "r1", "and a second one")], "task_id string, gt_index int, region_id string, gt_raw string")
    texts = spark.createDataFrame([("1", "m", "some text here\n\nand a second one\n\nextra words nobody asked for"), ("2", "m", "a page that has no regions")], "task_id string, model string, text string")
    found = align.align(regions, texts, mode="simple")
    notes = align.notes(found, texts, regions)
    assert {r["task_id"]: r["notes"] for r in rows(notes)} == {"1": ["unmatched_predictions=1"], "2": ["no_gt_regions"]}
    segments = texts.select("task_id", "model", S.segments(F.col("text")).alias("pred_segments"))
    tasks = spark.createDataFrame([("1", 7, 2)], "task_id string, inner_id int, region_count int")
    report = reports.alignment_reports(found, align.task_metrics(found), "simple", segments=segments, notes=notes, documents=align.document_metrics(regions, texts), tasks=tasks)
    reports.write_alignments(report, str(tmp_path / "a"))
    doc = json.loads(next(p for p in (tmp_path / "a").iterdir() if p.suffix == ".json" and p.stat().st_size).read_text())
    assert doc["pred_segment_count"] == 3 == len(doc["pred_segments"]) and doc["notes"] == ["unmatched_predictions=1"] and doc["manifest_task"] == {"task_id": "1", "inner_id": 7, "region_count": 2} and doc["document_gt_char_len"] == 32
    assert reports.read_alignments(spark, str(tmp_path / "a"), lines=True).count() == 2
    twice = spark.createDataFrame([("1 ", {"k": "old"}, 0), ("1", {"k": "new"}, 1)], "task_id string, data map<string,string>, position int")
    joined = strata.joined(found, twice, regions.withColumn("choices", F.expr("map('c', array('x'))")), ["c"], ["k"])
    assert [(r["c"], r["task_data.k"]) for r in rows(joined)] == [("x", "new")] * 2
    said = json.loads(reports.json_report(strata.strata(joined, ["c"]), joined.withColumn("source_file", F.lit("f"))).first()[0])
    assert said["n"] == 2 and said["files"] == 1 and said["skipped"] == 0 and [s["stratum"] for s in said["by"]["c"]] == ["x"] and set(said["by"]) == {"c", "__all__"}


def test_manifests_of_any_size(spark, tmp_path):
    box = "struct<x:double,y:double,width:double,height:double,rotation:double>"
    regions = spark.createDataFrame([("1", 1, "b", (1.0, 2.0, 3.0, 4.0, 0.0), "t2", {"k": ["v"]}), ("1", 0, "a", (1.0, 2.0, 3.0, 4.0, 0.0), "t1", {})], f"task_id string, gt_index int, region_id string, bbox {box}, gt_raw string, choices map<string,array<string>>")
    tasks = spark.createDataFrame([("1", 5, {"image": "p"}, "e.json", 0), ("2", 6, {}, "e.json", 1)], "task_id string, inner_id int, data map<string,string>, source_export string, position long")
    manifest.save_tasks(tasks, regions, str(tmp_path / "t"))
    again, each = manifest.load_tasks(spark, str(tmp_path / "t"))
    assert [(r["task_id"], r["inner_id"], r["position"]) for r in rows(again.orderBy("position"))] == [("1", 5, 0), ("2", 6, 1)]
    assert [(r["gt_index"], r["region_id"], r["gt_raw"], r["choices"]) for r in rows(each.orderBy("gt_index"))] == [(0, "a", "t1", {}), (1, "b", "t2", {"k": ["v"]})]
    with pytest.raises(ValueError):
        manifest.save_manifest(tasks, regions, str(tmp_path / "m"), most=1)


def test_document_scores_follow_the_reading_order(spark):
    box = "struct<x:double,y:double,width:double,height:double,rotation:double>"
    regions = spark.createDataFrame([("1", 0, "r0", (50.0, 10.0, 10.0, 5.0, 0.0), "second"), ("1", 1, "r1", (0.0, 10.5, 10.0, 5.0, 0.0), " first "), ("1", 2, "r2", (0.0, 80.0, 10.0, 5.0, 0.0), "**")], f"task_id string, gt_index int, region_id string, bbox {box}, gt_raw string")
    texts = spark.createDataFrame([("1", "m", "first second")], "task_id string, model string, text string")
    r = rows(align.document_metrics(regions, texts))[0]
    assert (r["document_gt_char_len"], r["document_pred_char_len"]) == (13, 12) and r["document_ned"] == 2 / 13 and r["document_wer"] == 0


def brute_normalized(text):
    """Every rule tried on every text: no marks are looked for first."""
    def every(table, t):
        for _, pattern, to in table:
            t = pattern.sub(to, t)
        return t

    t = every(N.OUTER_FENCES, unicodedata.normalize("NFKC", text))
    t = "".join(N.RINGED.get(ord(c), chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if c == "　" else c) for c in t)
    t = every(N.BLOCKS_AND_LINKS, every(N.COMMENTS, every(N.CODE_FENCES, every(N.IMAGES, every(N.LONG_RUNS, t)))))
    for _ in range(10):
        t = every(N.EMPHASIS, t)
    t = every(N.LATEX_DELIMITERS, every(N.LINE_MARKS, N.cells_only(t)))
    for _ in range(6):
        t = every(N.LATEX_WRAPPERS, t)
    return " ".join(every(N.LEFTOVERS, every(N.LATEX_MARKS, t)).split())


def test_normalisation_of_whole_tables(spark, sf_dir):
    texts = [r[0] or "" for r in registry.read(spark, sf_dir, "documents").select("text").collect()] + [r[0] or "" for r in registry.read(spark, sf_dir, "pages").select("html").collect()]
    odd = ["***a** b* __c__ ~~d~~", "| a | b |\n|---|:-:|\n| 1 |\n", "x\r\ny\x0cz\n", "\\text{a \\mathbf{b}} x_{i}^2 \\& \\foo*[q] $z$", "```py\nx\n```\n# T\n- [x] i\n1. j\n> q\n---\n***\n", "[a](b 'c') ![i](j) [k][l] [^m] <https://u.v> <b>w</b> [[n]]", "①⑳ⓐ Ａ　" + "_" * 9 + " " * 9, "[r]: http://x\ny", "`a` ``b``"]
    for text in texts + odd:
        assert N.normalized(text) == brute_normalized(text), text
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(N.normalize(F.col("t")), S.flattened(F.col("t")), N.artifacts(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(N.normalized(t), S.flat(t), N.answer(t)) for t in odd]
    assert N.normalized("**Title** _x_  y") == "Title x y" and N.normalized(odd[1]) == "a b 1" and N.normalized(odd[3]) == "a b x i 2 & z"


def test_single_steps_in_the_jvm_agree(spark):
    odd = ["a_____b      c", "①⑩⑳ⓐⓏ", "ＡＢ　！", "![a](b)x<!-- y\n -->z", "aaaa----\n\n\n\nb"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(N.long_runs(F.col("t")), N.ringed(F.col("t")), N.half_width(F.col("t")), N.images(F.col("t")), N.comments(F.col("t")), N.repeats(F.col("t"))).collect()
    for t, r in zip(odd, got):
        assert tuple(r) == (N.applied(N.LONG_RUNS, t), t.translate(N.RINGED), t.translate({k: v for k, v in N._PLAIN.items() if k not in N.RINGED}), N.applied(N.IMAGES, t), N.applied(N.COMMENTS, t), N.shorter_repeats(t, 3))
    assert spark.range(1).select(models.longest(F.array(F.lit("a"), F.lit("bb"), F.lit("cc"))), models.first_filled(F.array(F.lit(" "), F.lit("x")))).first()[:] == ("bb", "x")


def test_word_rates_by_brute_force(spark, sf_dir):
    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    pairs = registry.turn_pairs(spark, sf_dir).select("conv_id", "turn", "ref", "hyp").collect()
    got = {(r["conv_id"], r["turn"]): r["wer"] for r in rows(registry.wer_pairs(spark, sf_dir))}
    assert got == {(r.conv_id, r.turn): round(distance(r.ref.split(), r.hyp.split()) / len(r.ref.split()) if r.ref.split() else float(bool(r.hyp.split())), 6) for r in pairs}
    best = spark.createDataFrame([(r.ref[:15], r.hyp[:60]) for r in pairs], "a string, b string").select("a", "b", M.best_window(F.col("a"), F.col("b")).alias("w")).collect()
    for r in best:
        n = len(r.a)
        want = min(((distance(r.a, r.b[i : i + n]), i) for i in range(len(r.b) - n + 1)), default=None) if 0 < n <= len(r.b) else None
        assert (r.w and (round(r.w.d * n), r.w.at)) == want


def test_followed_predictions(spark, tmp_path):
    regions = spark.createDataFrame([("1", 0, "r0", "some text here")], "task_id string, gt_index int, region_id string, gt_raw string")
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"task_id": "1", "model": f"m{k}", "text": "some text here", "arrived": "2026-01-01T00:00:00"}))
        follow.follow(spark, str(tmp_path / "in"), regions, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r["model"], r["ned"]) for r in rows(spark.read.parquet(str(tmp_path / "out")))) == [("m0", 0.0), ("m1", 0.0)]


def test_simple_matching_is_the_cheapest_on_pages(spark, sf_dir):
    """No other assignment of as many pairs costs less: checked by every exchange of two and every unused segment."""
    regions, texts = registry.conversation_pages(spark, sf_dir)
    held = align.align(regions, texts, mode="simple").groupBy("task_id").agg(F.collect_list(F.struct("gt_index", "gt_norm", "pred_indices")).alias("m")).collect()
    segs = {r["task_id"]: r["s"] for r in texts.select(F.col("task_id").cast("string").alias("task_id"), S.segments(N.artifacts(F.col("text"))).alias("s")).collect()}
    for page in held:
        pred = [N.normalized(s) for s in segs[page.task_id]]
        cost = solvers.costs([m.gt_norm for m in page.m], pred)
        own = {g: m.pred_indices[0] for g, m in enumerate(page.m) if m.pred_indices}
        assert len(own) == min(cost.shape)
        free = set(range(len(pred))) - set(own.values())
        for g, p in own.items():
            assert all(cost[g, p] <= cost[g, q] + 1e-9 for q in free)
            assert all(cost[g, p] + cost[h, q] <= cost[g, q] + cost[h, p] + 1e-9 for h, q in own.items())


def test_recognizer_hooks_and_exports(spark):
    class Marked(runs.Recognizer):
        markdown, extension = True, ".mmd"

        def page(self, index):
            self.index = index

        def read(self, content):
            return f"# {content.decode()}"

        def native(self):
            return f"native {self.index}"

        def json(self):
            return json.dumps({"page": self.index})

    runs.register("marked", Marked)
    pages = spark.createDataFrame([(k, f"p{k}".encode()) for k in range(2)], "page_index int, content binary")
    found = runs.run(pages, ["marked", "echo"]).cache()
    got = {(r["model"], r["page_index"]): r for r in rows(found)}
    assert got["marked", 1]["native"] == "native 1" and got["marked", 1]["json"] == '{"page": 1}' and got["echo", 0]["native"] is None and got["echo", 0]["peak_mb"] > 0
    texts = runs.combined(found, "model")
    assert {r["name"] for r in rows(runs.exports(texts))} == {"marked_output.mmd", "echo_output.txt"}
    assert {r["name"] for r in rows(runs.exports(texts, also_txt=True))} == {"marked_output.mmd", "marked_output.txt", "echo_output.txt"}
    said = runs.summary_table(runs.results(found), {"pages": "2"})
    assert said.startswith("pages: 2\n") and "marked           ok" in said and "echo             ok" in said
    del runs.REGISTRY["marked"]
