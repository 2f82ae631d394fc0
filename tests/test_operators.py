import io
import json
import tomllib
import zipfile

from pyspark.sql import functions as F

from equivox.functions.text import head
from equivox.operators import lexicons, matchers, oracle, parsers, scaffold, segment, similarity, triage
from equivox.schema import CHUNKS, TOKENS
from equivox.sources import html, tabular, targets

P = ("low", "high", "lexical", "object")


def one(spark, text):
    return triage.score(spark.createDataFrame([("u", text)], "uid string, text string")).first()


def test_triage_examples(spark):
    r = one(spark, "The Value shall be encoded and may be padded or truncated, and some implementations process it while others do not.")
    assert (r.modal_inconsistency_points, r.vague_points, r.coordination_points) == (3.0, 2.0, 2.5)
    assert one(spark, "X should be sent.").modal_inconsistency_points == 1.2
    assert one(spark, "Use some, certain, suitable, adequate, sufficient items.").vague_points == 4.0
    assert one(spark, "It is as needed.").vague_points == 1.0
    assert one(spark, "The frame is read.").score == 0.0
    assert one(spark, "The above shall apply.").anaphora_points == 1.5


def test_triage_with_tokens(spark):
    toks = [(0, "a", "NOUN", "nsubj", 1), (1, "b", "NOUN", "conj", 0), (2, "c", "NOUN", "conj", 0), (3, "d", "NOUN", "conj", 0), (4, "of", "ADP", "prep", 3), (5, "it", "PRON", "pobj", 4), (6, "read", "VERB", "nsubjpass", 4)]
    chunks = [(0, "a", "NOUN"), (1, "b", "NOUN")]
    df = spark.createDataFrame([("a, b and c or d of it is read", toks, chunks)], f"text string, tokens {TOKENS}, chunks {CHUNKS}")
    r = triage.score(df, tokens="tokens", chunks="chunks").first()
    assert (r.coordination_points, r.passive_no_actor_points, r.anaphora_points) == (5.0, 2.0, 2.5)


def judge(spark, pp=(), coord=(), sim=()):
    units = spark.createDataFrame([("u",)], "uid string")
    pp = spark.createDataFrame(list(pp), "uid string, parser string, off int, prep string, head string, head_off int")
    coord = spark.createDataFrame([("u", p, o, "and", [(w, 0) for w in ws]) for p, o, ws in coord], "uid string, parser string, off int, cc string, conj array<struct<text:string,start:int>>")
    return oracle.judge(units, pp, coord, spark.createDataFrame(list(sim), "a string, b string, sim double"), head, P).first()


def test_unit_aggregation(spark):
    r = judge(spark, pp=[("u", p, 5, "of", h, 0) for p, h in zip(P, ["drawn", "border", "drawn", "R4"])])
    assert (r.disagreement_score, r.n_loci, r.n_nocuous_loci, r.verdict, len(r.readings), r.readings[3].signature) == (0.3, 1, 0, "undetermined", 4, "r4")
    r = judge(spark, coord=[("low", 3, ["value", "length"]), ("high", 3, ["value", "item"])], sim=[("item", "length", 0.1)])
    assert (r.disagreement_score, r.n_nocuous_loci, r.verdict, round(r.semantic_distance, 6)) == (1.3, 1, "nocuous", 0.9)
    r = judge(spark, coord=[("low", 3, ["a", "b"]), ("high", 3, ["a", "b", "c"])])
    assert (r.disagreement_score, r.n_loci, r.verdict, len(r.readings)) == (0.0, 1, "none", 2)
    r = judge(spark, pp=[("u", "low", 1, "of", "a", 0), ("u", "high", 1, "of", "b", 0)], coord=[("low", 3, ["c", "d"]), ("high", 3, ["c", "e"])], sim=[("a", "b", 0.0)])
    assert (r.disagreement_score, r.n_loci, r.n_nocuous_loci, r.verdict) == (1.39, 2, 1, "nocuous")
    r = judge(spark, pp=[("u", "low", 1, "of", "a", 0)])
    assert (r.disagreement_score, r.n_loci, r.verdict) == (0.0, 0, "none")


def test_matchers(spark):
    def match(f, unit, findings, **kw):
        u = spark.createDataFrame([("u", *unit)], "uid string, spec string, section string, section_title string, subref string, anchor string, text string")
        r = f(u, spark.createDataFrame(findings, "kind string, value string, ord int"), **kw).first()
        return r.match_tag, r.precise

    u = ("PS3.5", "6.2.1", "", None, "PS3.5 6.2.1", "")
    both = [("prefix", "PS3.5 6", 0), ("prefix", "PS3.5 6.2.1", 1)]
    assert match(matchers.dicom, u, both) == ("anchor:PS3.5 6.2.1", True)
    assert match(matchers.dicom, u, both, compat=True) == ("anchor:PS3.5 6", False)
    other = ("PS3.7", "8", "", None, "PS3.7 8", "")
    assert match(matchers.dicom, other, [("prefix", "PS3.5 8", 0)]) == (None, False)
    assert match(matchers.dicom, other, [("prefix", "PS3.5 8", 0)], compat=True) == ("anchor:PS3.5 8", True)
    assert match(matchers.dicom, ("PS3.5", "6.2", "", "6.2-1", "PS3.5 Table 6.2-1", ""), [("prefix", "PS3.5 Table 6.2-1", 0)]) == ("anchor:PS3.5 Table 6.2-1", True)
    f = ("F", "3.2.1.5.6", "Prefixes", None, "", "see ref-1 here")
    assert match(matchers.fhir, f, [("section", "3.2.1.5.6", 0)]) == ("sect:3.2.1.5.6", True)
    assert match(matchers.fhir, f, [("section", "3.2.1", 0)]) == ("sect>:3.2.1", False)
    assert match(matchers.fhir, f, [("section", "3.2.1.5", 0)]) == ("sect>:3.2.1.5", True)
    assert match(matchers.fhir, ("F", "3.2", "", None, "", "x"), [("section", "3.2.1.5.6", 0)]) == ("sect<:3.2.1.5.6", False)
    assert match(matchers.fhir, f, [("concept", "Prefixes", 0)]) == ("concept:prefixes", True)
    assert match(matchers.fhir, f, [("invariant", "ref-1", 0)]) == ("inv:ref-1", True)


def test_sources(spark, tmp_path):
    book = '<div class="section"><a id="sect_6.2"></a><h2>6.2 Values</h2><p>This paragraph is long enough to be kept here.</p><div class="table"><a id="table_6.2-1"></a><p>A paragraph of the table that is long enough.</p></div></div><p>Front matter that has no section at all, so it goes.</p>'
    rows = html.docbook(spark.createDataFrame([("p", book)], "path string, html string"), "PS3.5").orderBy("pos").collect()
    assert [(r.section, r.section_title, r.anchor) for r in rows] == [("6.2", "Values", "PS3.5 6.2"), ("6.2", "Values", "PS3.5 Table 6.2-1")]
    page = '<p>Outside of the main segment, though long enough.</p><div id="segment-content"><h2>3.2.1 Search</h2><p>A sentence about searching that is long.</p><h3>Notes</h3><li>Another sentence in the notes, also long.</li></div>'
    rows = html.fhir_site(spark.createDataFrame([("site/search.html", page)], "path string, html string"), "FHIR R5").orderBy("pos").collect()
    assert [(r.section, r.section_title, r.uid) for r in rows] == [("3.2.1", "Search", "FHIR-R5:search:3.2.1:1"), ("3.2.1", "Notes", "FHIR-R5:search:3.2.1:2")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></c>')
        z.writestr("OEBPS/b.opf", '<package><manifest><item id="a" href="cover.xhtml"/><item id="b" href="AnnexB.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/cover.xhtml", "<p>The cover has nothing that anyone would want.</p>")
        z.writestr("OEBPS/AnnexB.xhtml", '<body><p>Seeded paragraph of the annex, long enough.</p><p class="h2" id="sec_17_3">17.3 Borders</p><p>The border shall be drawn around the text.</p></body>')
    rows = html.epub(spark.createDataFrame([("b", bytearray(data.getvalue()))], "path string, content binary"), "ISO").orderBy("pos").collect()
    assert [(r.section, r.section_title) for r in rows] == [("B", ""), ("17.3", "Borders")]
    items = [("d", 1, 0, "section_header", "5.1 Scope"), ("d", 1, 1, "text", "The scope is described by this sentence."), ("d", 1, 2, "text", "Contents ........ 5 and more of the same"), ("d", 2, 0, "code", "int main() { return 0; } // something")]
    rows = tabular.layout(spark.createDataFrame(items, "doc string, page int, pos int, label string, text string"), "PDF").collect()
    assert [(r.section, r.text) for r in rows] == [("5.1", "The scope is described by this sentence.")]
    tabular.write_units(html.docbook(spark.createDataFrame([("p", book)], "path string, html string"), "PS3.5"), str(tmp_path / "u"))
    assert tabular.read_units(spark, str(tmp_path / "u")).count() == 2
    (tmp_path / "t.toml").write_text(f'[target.x]\nkind = "jsonl"\npath = "{tmp_path}/u"\nlexicons = "spec, umls"\n')
    t = targets.load(str(tmp_path / "t.toml"))["x"]
    assert (t.matcher, t.lexicons, t.units(spark).count()) == ("none", ("spec", "umls"), 2)


def test_python_parser_failures(spark):
    def load():
        def parse(texts):
            if len(texts) > 1 or "bad" in texts[0]:
                raise RuntimeError("no")
            return [{"pp": [{"off": 1, "prep": "of", "head": texts[0], "head_off": 0}], "coord": []}]

        return parse

    units = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "fine")], "uid string, text string")
    pp, coord, errors = parsers.from_function(units, "own", load)
    assert sorted(r.head for r in pp.collect()) == ["fine", "good"]
    assert [(r.uid, r.error) for r in errors.collect()] == [("2", "RuntimeError: no")]


def test_trees():
    t = parsers.tree("(S (NP (NP (DT the) (NN value)) (PP (IN of) (NP (NN length)))) (VP (VBZ is) (ADJP (JJ red) (CC or) (JJ blue))))")
    d = parsers.tree_decisions(t)
    assert d["pp"] == [{"off": 2, "prep": "of", "head": "value", "head_off": -1}]
    assert [c["text"] for c in d["coord"][0]["conj"]] == ["red", "blue"] and d["coord"][0]["off"] == 6


def test_scaffold_parses(spark, tmp_path):
    readings = [{"parser": p, "kind": "pp-attach", "locus": "of@3", "resolution": r, "signature": r} for p, r in zip(P, ["drawn", "border", "drawn", "drawn"])]
    signals = [{"name": "vague", "points": 1.0, "reasons": ["1 vague: some"]}]
    row = ("u", "17.3.1.28", "Borders", "ISO 17.3", 'To determine if two adjoining "paragraphs" differ', "nocuous", 1.0, 1, "yes", 2.0, json.dumps(readings), json.dumps(signals))
    schema = "uid string, section string, section_title string, anchor string, text string, verdict string, disagreement_score double, n_nocuous_loci int, overlap_precise string, triage_score double, divergent_readings string, triage_signals string"
    out = scaffold.rendered(scaffold.picked(spark.createDataFrame([row] * 3, schema)), "ooxml")
    files = sorted(r.file for r in out.collect())
    base = "ooxml_17_3_1_28_to-determine-if-two-adjoining"
    assert files == [f"{base}.toml", f"{base}_.toml", f"{base}__.toml"]
    case = tomllib.loads(out.first().toml)["case"]
    assert case["id"] == "ooxml/17.3.1.28-to-determine-if-two-adjoining"
    assert all(x in case["ambiguity"] for x in ("drawn", "border", "1 vague: some"))
    assert scaffold.write(out, str(tmp_path)) == 3


def test_findings(spark):
    toml = '[case]\nid = "UN handling"\ntitle = "Length of ob x-ui"\nspec = ["PS3.5 §T6.2-1", "PS3.5 Note 3", "PS3.5 8.1 Note 2", "FHIR R5 3.2.1.5.6 Prefixes", "HL7 FHIR section 2.1.28 and 3.2.4 (ref-1)", "CDA a/b", "some [x]"]\n[build]\nx = "inv ref-1"\n[control]\nt = ["0010,002a", "not 0010,0020"]\n'
    read = lexicons.cases(spark.createDataFrame([("a", toml), ("b", "not toml [")], "path string, toml string"))
    assert sorted(r.ok for r in read.collect()) == [False, True]
    d = {(r.kind, r.value) for r in lexicons.dicom_findings(read).collect()}
    assert {("prefix", "PS3.5 Table 6.2-1"), ("vr", "UN"), ("vr", "OB"), ("vr", "UI"), ("keyword", "struct"), ("keyword", "0010,002A"), ("prefix", "PS3.5 8.1 Note 2")} <= d and ("prefix", "PS3.5 Note 3") not in d
    f = {(r.kind, r.value) for r in lexicons.fhir_findings(read).collect()}
    assert f >= {("section", "3.2.1.5.6"), ("section", "2.1.28"), ("section", "3.2.4"), ("invariant", "ref-1"), ("concept", "Prefixes"), ("concept", "and")}
    assert not any(v in ("a/b", "some [x]") for _, v in f)
    lists = {r.kind: r for r in lexicons.findings_lists(lexicons.fhir_findings(read), read).collect()}
    assert lists["invariant"].list == ["ref-1"] and lists["section"].n == len(lists["section"].list) and lists["concept"].n_cases == 2
    codes = spark.createDataFrame([("u", json.dumps([{"code": "a", "display": "A b", "concept": [{"code": "c"}]}]))], "url string, json string")
    assert sorted(r.concept_id for r in lexicons.flatten_codes(codes).collect()) == ["u#a", "u#c"]


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame([(k, "One sentence that is long enough. And one more that is, too.") for k in range(20)], "doc int, text string")
    a = segment.explode_sentences(df).orderBy("doc", "sent_no").collect()
    b = segment.explode_sentences(df.repartition(7, F.rand(1))).orderBy("doc", "sent_no").collect()
    assert a == b and (a[1].char_start, a[1].char_end) == (34, 60)


def test_stream(spark, tmp_path):
    from equivox.streaming import triage as st

    src = html.docbook(spark.createDataFrame([("p", '<div class="section"><a id="sect_1"></a><p>It shall be sent and may be padded or truncated.</p></div>')], "path string, html string"), "S")
    tabular.write_units(src, str(tmp_path / "in"))
    st.write(st.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().score > 0


def test_html_block_query_keeps_whole_blocks(spark):
    import re
    from html import unescape

    from equivox.plans.catalogue import QUERIES

    data = "/root/testdata/sf0.001"
    page = "<h2>One <em>marked</em> title</h2><p>Some <b>bold</b> and <a href='x'>linked</a> text.</p><ul><li><a href='y'>The</a></li><li></li></ul><h3><span>Next</span></h3><p>Line<br>break.</p>"
    df = spark.createDataFrame([(1, page), (2, None), (None, "<p>No <i>head</i></p>")], "page_id long, html string")
    assert sorted(map(tuple, html.block_fill(df).collect()), key=str) == sorted(
        [(1, 0, "h2", "One marked title", "One marked title"), (1, 1, "p", "Some bold and linked text.", "One marked title"), (1, 2, "li", "The", "One marked title"), (1, 3, "h3", "Next", "Next"), (1, 4, "p", "Line break.", "Next"), (None, 0, "p", "No head", None)], key=str)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html").collect()}
    got = {}
    for r in QUERIES["html_blocks"](spark, data).collect():
        got.setdefault(r.page_id, []).append((r.pos, r.tag, r.text))
    for page_id, text in pages.items():
        plain = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "", text)
        ends = r"</\1>|<(?:p|li|h[1-6])[ >]|</(?:ul|ol|div|nav|article|footer|body|html)>|$"
        found = re.findall(rf"(?s)<(h[1-6]|p|li)(?: [^>]*)?>(.*?)(?={ends})", plain)
        want = [(tag, " ".join(unescape(re.sub("<[^>]*>", "", raw.replace("<br>", " "))).split())) for tag, raw in found if tag != "h6"]
        assert [(tag, x) for _, tag, x in sorted(got[page_id])] == [w for w in want if w[1]]


def test_section_fill_keeps_text_beside_inline_tags(spark):
    page = "<h2>A <em>title</em></h2><p><b>Bold start</b> and the rest</p><ul><li><a href='/x'>One</a></li><li>Some <i>x</i> tail<br>more</li></ul><p>" + "<b>w</b> " * 20_000
    got = html.section_fill(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.tag, r.text, r.title) for r in got[:4]] == [("h2", "A title", "A title"), ("p", "Bold start and the rest", "A title"), ("li", "One", "A title"), ("li", "Some x tail more", "A title")]
    assert got[4].text == " ".join(["w"] * 20_000)


def test_default_semantic_types(spark):
    known = spark.createDataFrame([("fever", "C1"), ("concept", "C2"), ("hip", "C3")], "norm string, cui string")
    types = spark.createDataFrame([("C1", "T184"), ("C2", "T078"), ("C3", "T023")], "cui string, tui string")
    assert [tuple(r) for r in similarity.join_concepts(known, types).collect()] == [("fever", "C1")]
    assert len(set(similarity.SEMANTIC_TYPES)) == 67
