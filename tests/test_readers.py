"""Files of an OCR service and golden files."""

import json

from paperledger.sources import exchange


def test_ocr_json(spark, tmp_path):
    cell = {"row": 0, "col": 1, "rowspan": 1, "colspan": 2, "header": True, "text": "Цена"}
    boxes = [{"text": "a", "bbox": [1, 2, 3, 4]}, {"text": " ", "bbox": [1, 2, 3, 4]}, {"text": "b", "bbox": [1, 2]}, {"text": "c", "bbox": [5, 6, 7, 8.5]}]
    files = {
        "d1-p1": {"text": "a | b|c", "flat": " ", "boxes": boxes, "tables": [{"cells": [cell]}, {"cells": []}]},
        "d1-p2": {"text": "x", "flat": "y", "tables": [{"cells": [cell, cell]}]}, "d2": {"error": "busy", "text": "q", "boxes": boxes}, "d4": {},
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False))
    (tmp_path / "d3.json").write_text("no json")
    words, cells, pages = exchange.read_ocr_json(spark, str(tmp_path))
    assert sorted(map(tuple, words.collect())) == [("d1", 1, 0, "a", 1.0, 2.0, 3.0, 4.0), ("d1", 1, 3, "c", 5.0, 6.0, 7.0, 8.5)]
    assert sorted((r.doc_id, r.grid_no, r.col, r.colspan, r.header, r.text) for r in cells.collect()) == [("d1", 0, 1, 2, True, "Цена")] + [("d1", 2, 1, 2, True, "Цена")] * 2
    got = {(r.doc_id, r.page_no): (r.layout, r.flat, r.error) for r in pages.collect()}
    assert got == {("d1", 1): ("a | b|c", "a b c", None), ("d1", 2): ("x", "y", None), ("d2", 1): (None, None, "busy"), ("d3", 1): (None, None, "no response"), ("d4", 1): ("", "", None)}


def test_expected(spark, tmp_path):
    top = tmp_path / "golden"
    (top / "a").mkdir(parents=True)
    put = lambda p, x: (top / p).write_text(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))
    put("a/expected.json", {"doc_type": "act", "fields": {"number": {"value": " 5 "}, "total": {"value": None}, "odd": {"x": 1}}, "lines": [1]})
    put("a.json", {"doc_type": "invoice"})
    put("b.json", {"doc_type": "invoice", "total": "7.00", "unp": None, "fields": {"kpp": "9"}})
    put("expected.json", {"b.pdf": {"doc_type": "x"}, "c.jpg": {"doc_type": "upd", "number": 3}, "d.png": None})
    put("bad.json", "no json")
    got = sorted(map(tuple, exchange.read_expected(spark, str(top)).collect()), key=str)
    want = [("a", "doc_type", "act"), ("a", "number", "5"), ("a", "total", None), ("b", "doc_type", "invoice"), ("b", "total", "7.00"), ("b", "unp", None), ("b", "kpp", "9"), ("c", "doc_type", "upd"), ("c", "number", "3")]
    assert got == sorted(want, key=str)
