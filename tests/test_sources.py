"""Importers, text files and settings on files written here."""

from __future__ import annotations

import io
import zipfile

import pytest

from quillstream import config
from quillstream.sources import files, packages

W = 'xmlns:w="http://example.org/w"'


def zipped(name, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, body)
    return out.getvalue()


def docx(*paragraphs):
    return zipped("word/document.xml", f"<w:document {W}><w:body>{''.join(paragraphs)}</w:body></w:document>")


def test_word_processor_file():
    text = lambda s: f"<w:r><w:t>{s}</w:t></w:r>"
    styled = lambda style, s: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{text(s)}</w:p>'
    content = docx(
        styled("Title", "Harbour"),
        styled("Heading 2", "Night"),
        f"<w:p>{text('Fog &amp; rain')}<w:r><w:tab/></w:r>{text('came.')}<w:r><w:delText>gone</w:delText></w:r></w:p>",
        "<w:p/>",
        f"<w:tbl><w:tr><w:tc><w:p>{text('cell')}</w:p></w:tc></w:tr></w:tbl>",
        f"<w:p><w:pPr><w:numPr/></w:pPr>{text('rope')}</w:p>",
        f"<w:p>{text('#not a title')}</w:p>",
    )
    assert packages.word_processor(content) == [("", "markdown", "# Harbour\n\n## Night\n\nFog & rain came.\n\n- rope\n\n\\#not a title")]
    with pytest.raises(ValueError):
        packages.word_processor(zipped("other.xml", "<a/>"))


def test_script_notes_and_sheets():
    fdx = '<FinalDraft><Content><Paragraph Type="Character"><Text>Mara</Text></Paragraph><Paragraph Type="Dialogue"><Text>Wait </Text><Text>here.</Text></Paragraph><Paragraph Type="Action"><Text>She runs.</Text></Paragraph></Content><Other><Paragraph><Text>no</Text></Paragraph></Other></FinalDraft>'
    assert packages.script(fdx.encode()) == [("", "fountain", "\nMARA\nWait here.\n\nShe runs.\n\n")]
    tbx = '<tbx><item><attribute name="Name">Top</attribute><item><attribute name="Name"> In </attribute><text>one&#13;two<b>x</b>!</text></item><item><text>bare</text></item></item></tbx>'
    assert packages.notes(tbx.encode()) == [("/Top/In", "plain", "one\ntwo!"), ("/Top/Untitled", "plain", "bare")]
    sheet = '<sheet><string><p><tags><tag kind="heading2"/></tags>Dawn</p><p>Gulls.</p></string><p>outside</p></sheet>'
    assert packages.zipped_sheet(zipped("a/Content.xml", sheet)) == [("", "markdown", "## Dawn\n\nGulls.")]
    deep = lambda n: ("<tbx>" + "<item>" * n + "<text>x</text>" + "</item>" * n + "</tbx>").encode()
    assert len(packages.notes(deep(256))) == 1
    with pytest.raises(ValueError):
        packages.notes(deep(257))


def test_damaged_files_are_rows(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("<w:p><w:r><w:t>Fine.</w:t></w:r></w:p>"))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = {r.path[-6:]: r for r in packages.read_packages(spark, str(tmp_path), "docx").collect()}
    assert rows["a.docx"].source == "Fine." and rows["a.docx"].error is None
    assert rows["b.docx"].source is None and rows["b.docx"].error


def test_project(spark, tmp_path):
    home = tmp_path / "novel.scriv"
    for key, body in (("A1", rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 She said \u8220?no\u8221?.\par Caf\'e9.}"), ("B2", rb"{\rtf1 Second.}"), ("C3", rb"{\rtf1 research}")):
        (home / "Files/Data" / key).mkdir(parents=True)
        (home / "Files/Data" / key / "content.rtf").write_bytes(body)
    (home / "novel.scrivx").write_text('<Project><Binder><BinderItem Type="DraftFolder" UUID="D"><Title>Draft</Title><Children><BinderItem Type="Text" UUID="B2"><Title>One: two</Title></BinderItem><BinderItem Type="Text" UUID="A1"><Title>Last</Title></BinderItem></Children></BinderItem><BinderItem Type="Text" UUID="C3"><Title>Notes</Title></BinderItem></Binder></Project>')
    rows = packages.read_projects(spark, str(tmp_path)).orderBy("nth").collect()
    assert [(r.name.rpartition(".scriv")[2], r.source) for r in rows] == [("/Draft/One  two", "Second."), ("/Draft/Last", "She said “no”.\nCafé.")]


def test_texts_and_lists(spark, tmp_path):
    for name in ("a.MD", "b.fountain", "c.txt"):
        (tmp_path / name).write_text("x")
    every = f"{tmp_path}/*"
    rows = files.read_texts(spark, [every, f"{tmp_path}/a.MD"]).collect()
    assert sorted(r.format for r in rows) == ["fountain", "markdown", "plain"] and len({r.doc_id for r in rows}) == 3
    assert {r.format for r in files.read_texts(spark, [every], "plain").collect()} == {"plain"}
    (tmp_path / "list.txt").write_text("# note\n\n Kind Of \nsort of\nkind of\n")
    assert sorted(r.entry for r in files.read_list(spark, f"{tmp_path}/list.txt").collect()) == ["kind of", "sort of"]


def test_settings():
    c = config.from_toml('[echoes]\nwindow = 30\n[lexicon]\nhedges = ["Sort Of"]\nignore = ["perhaps", "early"]\n[check]\nmax_adverbs_per_1k = 8.0\nmin_mattr = 0.7\nmax_grade = 12\n[check.severity]\nadverbs = "warn"\n')
    assert c.echoes.window == 30 and c.echoes.min_length == 4
    assert c.limits_rows() == [("adverbs_per_1k", "max", 8.0, "warn"), ("mattr", "min", 0.7, "error"), ("flesch_kincaid_grade", "max", 12.0, "error")]
    lists = c.lists({"tics": ["somehow"]})
    assert "sort of" in lists["hedges"] and "perhaps" not in lists["hedges"] and "early" in lists["not_adverbs"] and lists["tics"] == ("somehow",)
    for bad in ("[echo]\n", "[echoes]\nwidth = 3\n", '[echoes]\nwindow = "3"\n', "[check]\nmax_words = 3\n", '[check.severity]\nadverbs = "fatal"\n'):
        with pytest.raises(ValueError):
            config.from_toml(bad)
    with pytest.raises(ValueError):
        c.lists({"nouns": ["x"]})
    assert all(config.from_toml(text) for text in config.PRESETS.values())
