"""Word-processing packages, made as element trees in the real namespaces and read natively."""

import xml.etree.ElementTree as ET
import zipfile
from io import BytesIO

import pytest

from parchment.sources.docx import Part, read_any, read_docx
from parchment.sources.ooxml import NAMESPACES, RELATIONSHIPS, read_parts
from parchment.tree import blocks, plain_block, spans

for prefix, uri in NAMESPACES.items():
    ET.register_namespace(prefix, uri)


def name(short):
    prefix, _, local = short.rpartition(":")
    return f"{{{NAMESPACES[prefix or 'w']}}}{local}"


def el(tag, *inside, **attributes):
    """An element of the w namespace unless the tag says otherwise; an underscore in an attribute stands for its colon."""
    made = ET.Element(name(tag), {name(k.replace("_", ":")): str(v) for k, v in attributes.items()})
    for x in inside:
        if isinstance(x, str):
            made.text = x
        else:
            made.append(x)
    return made


def run(text, *properties):
    return el("r", el("rPr", *properties), el("t", text))


def para(*inside, style=None, number=None):
    properties = el("pPr")
    if style:
        properties.append(el("pStyle", val=style))
    if number:
        properties.append(el("numPr", el("ilvl", val=number[1]), el("numId", val=number[0])))
    return el("p", properties, *[run(x) if isinstance(x, str) else x for x in inside])


def cell(*inside, **properties):
    return el("tc", el("tcPr", *[el(k, **({} if v is None else {"val": v})) for k, v in properties.items()]), *inside)


class Writer:
    """Collects parts and zips them."""

    def __init__(self, *body):
        self.parts = {"word/document.xml": ET.tostring(el("document", el("body", *body)))}

    def add(self, part, *inside):
        self.parts[f"word/{part}.xml"] = ET.tostring(el(part, *inside))
        return self

    def raw(self, **parts):
        self.parts |= {k.replace("__", "/").replace("_dot_", "."): v for k, v in parts.items()}
        return self

    def relate(self, **targets):
        root = ET.Element(f"{{{RELATIONSHIPS}}}Relationships")
        for i, (kind, target) in targets.items():
            ET.SubElement(root, f"{{{RELATIONSHIPS}}}Relationship", {"Id": i, "Type": f"http://example.com/{kind}", "Target": target} | ({"TargetMode": "External"} if "://" in target else {}))
        self.parts["word/_rels/document.xml.rels"] = ET.tostring(root)
        return self

    def bytes(self):
        out = BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for path, data in self.parts.items():
                archive.writestr(path, data)
        return out.getvalue()


def lossy(job):
    return [(e["feature"], e["loss_class"]) for e in job.loss if e["loss_class"] != "none"]


def numbering(fmt="lowerLetter", start=4):
    level = el("lvl", el("start", val=start), el("numFmt", val=fmt), ilvl=0)
    return el("abstractNum", level, abstractNumId=9), el("num", el("abstractNumId", val=9), numId=2)


def test_headings_make_sections():
    styles = el("style", el("name", val="Chapter"), el("pPr", el("outlineLvl", val=1)), styleId="Ch", type="paragraph")
    nodes, _ = read_docx(Writer(para("before"), para("One", style="Ch"), para("text"), para("Two", style="heading 1")).add("styles", styles).bytes())
    assert [n["type"] for n in nodes] == ["paragraph", "section", "section"]
    assert [(h["level"], plain_block(h)) for h in blocks(nodes) if h["type"] == "heading"] == [(2, "One"), (1, "Two")]


def test_lists_nest_by_level_and_end_with_a_plain_paragraph():
    given = Writer(para("a", number=(2, 0)), para("deep", number=(2, 1)), para("b", number=(2, 0)), para("plain"), para("c", number=(2, 0)))
    nodes, _ = read_docx(given.add("numbering", *numbering()).bytes())
    first, plain, second = nodes
    assert (first["style"], first["start"], len(first["items"]), plain["type"], len(second["items"])) == ("ordered", 4, 2, "paragraph", 1)
    assert [c["type"] for c in first["items"][0]["children"]] == ["paragraph", "list"]


def test_marks_and_style_flags():
    styles = el("style", el("rPr", el("i")), styleId="Slanted", type="character")
    body = para(run("x", el("strike"), el("u", val="single")), run("y", el("rStyle", val="Slanted")), run("z", el("b", val="false")))
    nodes, _ = read_docx(Writer(body).add("styles", styles).bytes())
    assert [s["type"] for s in spans(nodes)] == ["strike", "underline", "text", "em", "text", "text"]


def test_changes_are_taken_in_their_final_view():
    body = para(el("ins", run("kept"), author="Ann"), el("del", el("r", el("delText", "gone")), author="Ben"), el("moveTo", run(" moved"), author="Ben"))
    nodes, job = read_docx(Writer(body).bytes())
    assert plain_block(nodes[0]) == "kept moved"
    (event,) = [e for e in job.loss if e["loss_class"] != "none"]
    assert (event["feature"], event["detail"]) == ("docx_tracked_changes", "Ann: +1 -0; Ben: +1 -1")
    assert b"gone" in job.preserved[0]["bytes"]


def test_table_grid():
    grid = el("tblGrid", el("gridCol", w=200), el("gridCol", w=600))
    rows = [
        el("tr", el("trPr", el("tblHeader")), cell(para("wide"), gridSpan=2)),
        el("tr", cell(para("tall"), vMerge="restart"), cell(para("1"))),
        el("tr", cell(para(), vMerge=None), cell(para("2"))),
    ]
    (table,), _ = read_docx(Writer(el("tbl", grid, *rows)).bytes())
    assert [c["extra"]["width"] for c in table["columns"]] == [0.25, 0.75]
    assert [[(c["col"], c.get("col_span", 1), c.get("row_span", 1), c.get("role")) for c in r["cells"]] for r in table["rows"]] == [[(0, 2, 1, "header")], [(0, 1, 2, None), (1, 1, 1, None)], [(1, 1, 1, None)]]


def test_notes_are_defined_once_and_numbered_apart():
    ref = lambda kind, i: el("r", el(f"{kind}Reference", id=i))
    given = Writer(para("t", ref("footnote", 3), ref("endnote", 3), ref("footnote", 3)))
    given.add("footnotes", el("footnote", para("rule"), id=0), el("footnote", para("foot"), id=3)).add("endnotes", el("endnote", para("end"), id=3))
    nodes, job = read_docx(given.bytes())
    targets = [s["target_ref"] for s in spans(nodes) if s["type"] == "footnote_ref"]
    assert targets[0] == targets[2] != targets[1]
    assert [plain_block(n) for n in nodes if n["type"] == "footnote"] == ["foot", "end"]
    assert lossy(job) == [("docx_endnotes", "partial")]


def test_comments_quote_their_range():
    mark = lambda kind, i: el(f"commentRange{kind}", id=i)
    given = Writer(para("so ", mark("Start", 1), "this", mark("End", 1), " ends", mark("Start", 2)), para("over", mark("End", 2), mark("Start", 4)))
    given.add("comments", el("comment", para("why"), para("not"), id=1, author="Cy"), el("comment", para("two"), id=2), el("comment", para("lost"), id=3))
    nodes, job = read_docx(given.bytes())
    assert [(a["exact"], a["prefix"], a["suffix"], a["value"], a["author"], a["target_kind"]) for a in job.annotations] == [
        ("this", "so ", " ends", "why\nnot", "Cy", "text_quote"), (None, None, None, "two", "unknown", "block"), (None, None, None, "", "unknown", "block"),
    ]
    assert [a["target_block"] for a in job.annotations] == [nodes[0]["node_id"], nodes[0]["node_id"], nodes[1]["node_id"]]
    assert ("docx_comment", "partial") in lossy(job)


def test_links_images_and_what_is_kept():
    image = el("r", el("drawing", el("wp:docPr", descr="A cat"), el("a:blip", r_embed="pic")))
    body = [para(el("hyperlink", run("out"), r_id="web"), el("hyperlink", run("in"), anchor="here")), para(image), para("t", el("r", el("object", el("x"))))]
    given = Writer(*body).relate(web=("hyperlink", "https://example.com/"), pic=("image", "media/cat.png")).raw(word__media__cat_dot_png=b"PNG", word__header1_dot_xml=b"<h/>")
    nodes, job = read_docx(given.bytes())
    assert [s["url"] for s in spans(nodes) if s["type"] == "link"] == ["https://example.com/", "#here"]
    assert (nodes[1]["type"], nodes[1]["alt"], job.assets[0]["bytes"]) == ("figure", "A cat", b"PNG")
    assert set(lossy(job)) == {("docx_headers", "preserved_raw"), ("docx_ole_object", "preserved_raw"), ("docx_internal_link", "partial")}


def test_parts_of_a_package():
    parts = read_parts(Writer(para("a", style="S", number=(2, 0))).add("numbering", *numbering()).relate(x=("image", "media/x.png")).bytes())
    assert parts["levels"] == [{"abstract_id": "9", "ilvl": 0, "fmt": "lowerLetter", "start": 4}] and parts["numbers"] == [{"num_id": "2", "abstract_id": "9"}]
    assert [(p["style"], p["num_id"], p["ilvl"]) for p in parts["paragraphs"]] == [("S", "2", 0)]
    assert parts["rels"][0]["target"] == "media/x.png"


def test_readers_and_refusals():
    tree = '{"blocks":[{"t":"Para","c":[{"t":"Str","c":"other"}]}]}'
    good = Writer(para("own")).bytes()
    assert [plain_block(n) for n in read_any(good, tree, "auto")[0]] == ["own"]
    assert [plain_block(n) for n in read_any(good, tree, "pandoc")[0]] == ["other"]
    nodes, job = read_any(b"no archive", tree, "auto")
    assert plain_block(nodes[0]) == "other" and lossy(job) == [("docx_reader_fallback", "partial")]
    assert lossy(read_any(b"no archive", tree, "native")[1]) == lossy(read_any(good, None, "pandoc")[1]) == [("docx_unreadable", "unsupported")]
    entity = Writer().raw(word__document_dot_xml=b"<!DOCTYPE a><a/>")
    with pytest.raises(Part):
        read_docx(entity.bytes())
