"""Fixtures with results counted by hand: lines, lists, references, sources."""

import json

from conftest import rows
from pyspark.sql import functions as F

from paperloom.functions import extract as X
from paperloom.functions import latex as L
from paperloom.functions import prose as P
from paperloom.functions import quantity as Q
from paperloom.functions import text as T
from paperloom.operators import objects as O
from paperloom.operators import windows as W
from paperloom.operators.scan import chunk_of
from paperloom.sources import parsers as PA
from paperloom.sources import readers as R
from paperloom.sources import sinks as S


def lines(spark, data):
    return spark.createDataFrame([("d", *r) for r in data], "doc string, page int, line_index int, type string, text string, block int, par int")


def test_paragraph_breaks(spark):
    d = lines(spark, [
        (1, 0, "title", "Abstract", None, None), (1, 1, "text", r"\begin{abstract}", None, None), (1, 2, "text", "inside", None, None), (1, 3, "text", r"\end{abstract}", None, None),
        (1, 4, "text", "one", 1, 1), (1, 5, "text", "two", None, None), (1, 6, "text", "three", 1, 1), (1, 7, "text", "four", 1, 2), (1, 8, "equation", "x", None, None), (1, 9, "quote", "five", 1, 2),
        (2, 0, "text", "six", 1, 2)])
    assert rows(O.paragraphs(d, "doc", ["block", "par"]), "page", "from_line", "text") == [(1, 4, "one two three"), (1, 7, "four"), (1, 9, "five"), (2, 0, "six")]


def test_abstract_region_crosses_pages(spark):
    d = lines(spark, [(1, 0, "abstract", "a", None, None), (1, 1, "text", "in", None, None), (2, 0, "text", "still in", None, None), (2, 1, "text", r"\end{abstract}", None, None), (2, 2, "text", "out", None, None)])
    assert rows(O.paragraphs(d, "doc"), "page", "text") == [(2, "out")]


def test_lists(spark):
    d = lines(spark, [(1, 0, "text", "• one • two", None, None), (1, 1, "text", "3. three", None, None), (1, 2, "text", "plain", None, None), (1, 3, "text", "a) four", None, None)])
    assert rows(O.list_items(d, "doc"), "line_index", "marker", "content") == [(0, "•", "one"), (0, "•", "two"), (1, "3.", "three"), (3, "a)", "four")]
    i = spark.createDataFrame([("d", 1, 0, "•", 0.0), ("d", 1, 1, "•", 0.1), ("d", 1, 2, "•", 0.2), ("d", 1, 3, "•", 0.1), ("d", 1, 60, "•", 0.1), ("d", 1, 61, "1.", 0.1)], "doc string, page int, line_index int, marker string, indent double")
    assert rows(O.list_depth(i, "doc"), "line_index", "list_no", "depth") == [(0, 1, 1), (1, 1, 2), (2, 1, 3), (3, 1, 2), (60, 2, 1), (61, 3, 1)]


def test_hyphens(spark):
    d = spark.createDataFrame([("d", 0, "a self-"), ("d", 1, "made exam-"), ("d", 2, "ple ends"), ("d", 3, "Non-"), ("d", 4, "Euclid")], "doc string, pos int, text string")
    assert rows(O.dehyphen(d, ["doc"], "pos"), "cleaned", "joins") == [("a selfmade example ends Non- Euclid", 2)]
    assert rows(O.dehyphen_strict(d, ["doc"], "pos"), "cleaned", "joins") == [("a self-made example ends Non-Euclid", 1)]


def test_references(spark):
    data = [("section_header", "References"), ("text", "[5]. A. Kuhn. On"), ("text", "things, 2019."), ("text", "B. Roth. More 12-19."), ("text", "C. Last"), ("section_header", "Appendix"), ("text", "no 2020.")]
    d = spark.createDataFrame([("d", i, ty, tx) for i, (ty, tx) in enumerate(data)], "doc string, pos long, type string, text string")
    assert rows(O.reference_entries(d, "doc", "pos", chunk_of("pos", 2)), "number", "raw_text", "year") == [(2, "B. Roth. More 12-19.", ""), (3, "C. Last", ""), (5, "[5]. A. Kuhn. On things, 2019.", "2019")]
    one = spark.createDataFrame([("d", i, "text", t) for i, t in enumerate(["Bibliography", "Kuhn 2001 a", "Roth 2002 b", "Vogel 2003 c"])], "doc string, pos long, type string, text string")
    assert O.reference_entries(one, "doc", "pos", chunk_of("pos", 2)).count() == 3


def test_section_numbers(spark):
    d = spark.createDataFrame([("d", i, lv, ap) for i, (lv, ap) in enumerate([(2, False), (3, False), (3, False), (2, False), (4, False), (2, True), (3, False)])], "doc string, pos long, level int, is_appendix boolean")
    for n in (1, 2, 100):
        assert [r["section_number"] for r in W.section_tree(d, "doc", "pos", chunk_of("pos", n)).orderBy("pos").collect()] == ["1", "1.1", "1.2", "2", "2.1", "3", "3.1"]
        assert [r["index"] for r in W.fractal_index(d, "doc", "pos", chunk_of("pos", n)).orderBy("pos").collect()] == ["1", "1.1", "1.2", "2", "2.1.1", "A", "A.1"]


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_scalars(spark):
    assert one(spark, X.iban_valid(F.lit("DE89 3704 0044 0532 0130 00"))) is True
    assert one(spark, X.iban_valid(F.lit("DE89370400440532013001"))) is False
    assert one(spark, X.isbn13_valid(F.lit("9783161484100"))) is True
    assert one(spark, X.isbn10_valid(F.lit("080442957X"))) is True
    assert one(spark, X.issn_valid(F.lit("03785955"))) is True
    assert one(spark, T.roman_value(F.lit("MCMXCIV"))) == 1994
    assert one(spark, T.number_list(F.lit("1, 3-5; 1-99; x"))) == [1, 3, 4, 5]
    assert one(spark, T.fold(F.lit(" Élan ﬁne Ü "))) == "elan fine u"
    assert one(spark, Q.convert(F.lit(2.0), F.lit("h"), F.lit("min"))) == 120.0
    assert one(spark, Q.convert(F.lit(2.0), F.lit("h"), F.lit("EUR"))) is None
    assert one(spark, X.norm_date(F.lit("am 3.4.2021"))) == "20210403"


def test_quantities(spark):
    ok = lambda s: one(spark, Q.latex_quantity(F.lit(s)))
    assert (ok(r"2 \cdot 3 = 6")["kind"], ok(r"2 \cdot 3 = 6")["terms"]) == ("derivation", [2.0, 3.0])
    assert (ok(r"82\%")["kind"], ok(r"\$ 5")["value"], ok("R@P90")["name"]) == ("ratio", 5.0, "R@P")
    assert ok("x + y") is None
    check = lambda ts, op, v: one(spark, Q.check_stated(Q.recompute(F.array(*[F.lit(float(x)) for x in ts]), F.lit(op)), F.lit(float(v))))
    assert (check([2, 3], "mul", 6), check([2, 3], "mul", 7), check([1, 0], "div", 7)) == ("verified", "refuted", "uncheckable")
    d = spark.createDataFrame([("d", "5,550,689 facts, in 12 ms at 82% for $5 and 7 cats")], "doc string, text string")
    assert rows(Q.prose_quantities(d, "doc", "text"), "kind", "amount") == [("count", 5550689.0), ("money", 5.0), ("number", 12.0), ("ratio", 82.0)]


def test_acronyms_first_definition_wins(spark):
    d = spark.createDataFrame([("d", "A Hidden Markov Model (HMM) and (see below) a Heavy Metal Man (HMM); no (XQZ).")], "doc string, text string")
    assert rows(P.acronyms(d, "doc", "text"), "short", "long") == [("HMM", "Hidden Markov Model")]


def test_line_dump_files(spark, tmp_path):
    dump = {"source": "x", "pages": [{"page": 1, "image_id": "i", "page_width": 10.0, "page_height": 20.0, "lines": [{"id": "a", "type": "text", "text": "hi"}, {"id": "b", "type": "text", "text": "ho"}]}, {"page": 2, "lines": []}]}
    (tmp_path / "book.lines.json").write_text(json.dumps(dump))
    ln, pg = R.read_line_dump(spark, str(tmp_path))
    assert rows(ln, "bibkey", "page", "line_index", "text") == [("book", 1, 0, "hi"), ("book", 1, 1, "ho")]
    assert rows(pg, "bibkey", "page") == [("book", 1), ("book", 2)]


def test_word_files(spark, tmp_path):
    head = "\t".join(PA.WORD_COLUMNS)
    (tmp_path / "a.tsv").write_text(f"{head}\n1\t1\t0\t0\t0\t0\t0\t0\t600\t800\t-1\t\n5\t1\t1\t1\t1\t1\t10\t20\t30\t5\t96\tHi \"x\n5\t1\t1\t1\t1\t2\t10\t20\t30\t5\t96\t \nshort\n")
    w, p = R.read_words(spark, str(tmp_path / "a.tsv"))
    assert rows(w, "page", "x0", "x1", "text") == [(1, 10.0, 40.0, 'Hi "x')]
    assert rows(p, "page", "width", "height") == [(1, 600.0, 800.0)]


def test_row_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("page,x,y,w,h\n1,2,3,4,5\n")
    (tmp_path / "b.json").write_text('{"rows": [{"page": 1, "x0": 1, "y0": 2, "x1": 3, "y1": 4}]}')
    a, b = R.read_rows(spark, str(tmp_path / "a.csv")), R.read_rows(spark, str(tmp_path / "b.json"))
    assert R.rect_columns(a.columns)["mode"] == "xywh" and R.rect_columns(b.columns)["mode"] == "corner"
    assert a.count() == b.count() == 1


def test_xml_files(spark, tmp_path):
    (tmp_path / "g.xml").write_text('<rdf:RDF xmlns:rdf="r" xmlns:gndo="g"><rdf:Description rdf:about="https://d-nb.info/gnd/7"><rdf:type rdf:resource="S"/><gndo:preferredNameForTheSubjectHeading>Feld</gndo:preferredNameForTheSubjectHeading></rdf:Description></rdf:RDF>')
    (tmp_path / "s.xml").write_text('<synsets><synset id="s1" category="nomen"><lexUnit id="l"><orthForm>Haus</orthForm></lexUnit></synset></synsets>')
    assert rows(PA.authority_concepts(R.read_authority(spark, str(tmp_path / "g.xml")), types=["S"]), "code", "pref") == [("7", "Feld")]
    assert rows(R.read_synsets(spark, str(tmp_path / "s.xml")), "_id", "_category") == [("s1", "nomen")]


def test_model_round_trip_replaces_one_document(spark, tmp_path):
    path = str(tmp_path / "model")
    d = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "bibkey string, id string, text string")
    S.write_model({"object": d}, path)
    S.write_model({"object": spark.createDataFrame([("a", "1", "new")], d.schema)}, path)
    assert rows(S.read_model(spark, path, ["object"])["object"], "bibkey", "text") == [("a", "new"), ("b", "y")]


def test_bundle_files(spark, tmp_path):
    d = spark.createDataFrame([("Paragraph", "P 1", "Hello"), ("Paragraph", "index", "Idx")], "type string, id string, body string")
    S.write_files(S.bundle_files(d, "type", F.col("id"), F.col("id"), F.col("body"), "T"), str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "paragraph").iterdir()) == ["index_.md", "p_1.md"]
    assert "Hello" in (tmp_path / "paragraph" / "p_1.md").read_text()


def test_formula_lines(spark):
    want = {
        "a b": ["a right b"], "A_{i}^{h}": ["A sub i", "A sup h"], "x^a_b": ["x sup a", "x sub b"], "x^{a_b}": ["x sup a", "a sub b"], "{ab}^c": ["a right b", "b sup c"],
        r"\frac{a_1}{\sqrt{b}}^2 = c": [r"\frac above a", "a sub 1", r"\frac below \sqrt", r"\sqrt inside b", r"\frac sup 2", r"\frac right =", "= right c"],
        r"x^\frac12 y": [r"x sup \frac", r"\frac above 1", r"\frac below 2", "x right y"], r"\sum\limits_{i=1}^n i": [r"\sum sub i", "i right =", "= right 1", r"\sum sup n", r"\sum right i"],
        r"\hat x_i": [r"\hat inside x", r"\hat sub i"], "": [], "a}": None, "{a": None, "^2": None, "x^{}": None, "x^": None, r"\begin{a}x\end{a}": None, r"\frac a": None}
    d = spark.createDataFrame([(k,) for k in want], "tex string")
    assert {r.tex: r.lines for r in d.select("tex", L.formula_lines(F.col("tex")).alias("lines")).collect()} == want
