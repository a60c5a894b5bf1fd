"""Masking of Markdown and screenplay marks: what isn't prose becomes spaces, headings and paragraph breaks are noted.

These are line-by-line state machines over one document, which column expressions cannot state; a document is a row of an
Arrow batch and nothing is kept between rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

HEADINGS = "array<struct<level:int,title:string,line:int>>"
SCHEMA = f"doc_id long, source string, prose string, paras array<struct<section:int,text:string>>, headings {HEADINGS}"

SPEECH = "\ue001"  # before a spoken line of a screenplay


@dataclass
class Masked:
    prose: list[str] = field(default_factory=list)  # line by line
    headings: list[tuple[int, str, int]] = field(default_factory=list)  # level, title, line from 1
    breaks: set[int] = field(default_factory=set)  # lines that begin a paragraph


#: After a blanked character's space, one for each further byte of it; instead of the space of one that is two UTF-16 units.
FILL, WIDE = "\x1f", "\U000f0000"


def _blank(text: str) -> str:
    """A space for each byte. FILL and WIDE tell which spaces stand for one character, so that columns can be counted as well."""
    if text.isascii():
        return " " * len(text)
    return "".join((WIDE if c > "\uffff" else " ") + FILL * (len(c.encode()) - 1) for c in text)


def _bare(line: str) -> str:
    return line.replace(WIDE, " ").strip()


def by_bytes(text: str) -> str:
    """Blanked text with a space a byte."""
    return text.replace(FILL, " ").replace(WIDE, " ")


def by_characters(text: str) -> str:
    """Blanked text with a character for each of the source; a blanked one of two UTF-16 units is still of two."""
    return text.replace(FILL, "")


_INLINE = re.compile(
    r"(?P<code>(`+)(?:(?!\2).)+?\2(?!`))|(?P<tick>`+)"
    r"|(?P<image>!\[[^\]]*\](?:\([^)]*\)|\[[^\]]*\])?)|(?P<note>\[\^[^\]]*\])"
    r"|\[(?P<link>[^\]]*)\](?P<target>\([^)]*\)|\[[^\]]*\])"
    r"|(?P<tag></?[A-Za-z][^>]*>)|(?P<url>https?://\S+)"
    r"|(?P<escape>\\)(?=[^\w\s])|(?P<star>\*+|~~)|(?P<under>(?<![A-Za-z0-9])_+|_+(?![A-Za-z0-9]))"
)


def inline(line: str) -> str:
    """A line without code, images, link targets, tags, addresses and emphasis marks."""

    def swap(m: re.Match) -> str:
        if m["link"] is not None:
            return " " + inline(m["link"]) + " " + _blank(m["target"])
        return _blank(m[0])

    return _INLINE.sub(swap, line)


def title_of(text: str) -> str:
    return " ".join(by_bytes(inline(text)).split())


def markdown(source: str) -> Masked:
    out, lines = Masked(), source.split("\n")
    start = 0
    if lines and lines[0].rstrip() in ("---", "+++"):
        ends = ("---", "...") if lines[0].startswith("---") else ("+++",)
        start = next((k + 1 for k in range(1, len(lines)) if lines[k].rstrip() in ends), 0)
    out.prose = [_blank(x) for x in lines[:start]]
    fence, comment = "", False
    for k in range(start, len(lines)):
        line = lines[k].rstrip("\r")
        bare = line.strip()
        if fence:
            if re.fullmatch(re.escape(fence[0]) + "{%d,}" % len(fence), bare):
                fence = ""
            out.prose.append(_blank(line))
            continue
        if comment or "<!--" in line:
            kept, rest = "", line
            while rest:
                if comment:
                    head, mark, rest = rest.partition("-->")
                    kept += _blank(head + mark)
                    comment = not mark
                else:
                    head, mark, rest = rest.partition("<!--")
                    kept += head + _blank(mark)
                    comment = bool(mark)
            line, bare = kept, _bare(kept)
        if m := re.match(r"\s{0,3}(`{3,}|~{3,})", line):
            fence = m[1]
            out.prose.append(_blank(line))
        elif m := re.match(r"\s{0,3}(#{1,6})(?:\s+(.*))?$", line):
            out.headings.append((len(m[1]), title_of((m[2] or "").rstrip().rstrip("#")), k + 1))
            out.prose.append(_blank(line))
            out.breaks.add(k + 1)
        elif bare and (set(bare) == {"="} or (set(bare) == {"-"} and len(bare) > 1)) and out.prose and _bare(out.prose[-1]) and k not in out.breaks:
            out.headings.append((1 if bare[0] == "=" else 2, title_of(lines[k - 1]), k))
            out.prose[-1] = _blank(out.prose[-1])
            out.prose.append(_blank(line))
            out.breaks.add(k + 1)
        elif re.fullmatch(r"\s{0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})", line) or bare.startswith("|"):
            out.prose.append(_blank(line))
        else:
            rest, mask = line, ""
            while m := re.match(r"(\s*)(>\s?|[-*+]\s+(?:\[[ xX]\]\s+)?|\d{1,9}[.)]\s+)", rest):
                mask += _blank(m[0])
                if not m[2].startswith(">"):
                    out.breaks.add(k)
                rest = rest[len(m[0]) :]
            out.prose.append(mask + inline(rest))
    return out


_SCENE = re.compile(r"(?:INT|EXT|EST|INT\.?/EXT|I/E)[. ]", re.I)


def screenplay(source: str) -> Masked:
    """Fountain: title page, sections, scenes, transitions, cues, dialogue (quoted by the dialogue lines), notes."""
    source = re.sub(r"/\*.*?\*/|\[\[.*?\]\]", lambda m: "\n".join(map(_blank, m[0].split("\n"))), source, flags=re.S)
    out, lines = Masked(), source.split("\n")
    k = 0
    if lines and re.match(r"[A-Za-z][A-Za-z ]*:", lines[0]):
        while k < len(lines) and _bare(lines[k]):
            out.prose.append(_blank(lines[k]))
            k += 1
    speaking = False
    for k in range(k, len(lines)):
        line, bare = lines[k], _bare(lines[k])
        fresh = k == 0 or not _bare(lines[k - 1])
        following = k + 1 < len(lines) and bool(_bare(lines[k + 1]))
        if not bare:
            speaking = False
            out.prose.append(line)
        elif speaking:
            out.breaks.add(k)
            out.prose.append(_blank(line) if bare.startswith("(") and bare.endswith(")") else SPEECH + re.sub(r"[*_]", " ", line))
        elif m := re.match(r"\s*(#{1,6})\s*(.*)", line):
            out.headings.append((len(m[1]), by_bytes(m[2]).strip(), k + 1))
            out.prose.append(_blank(line))
            out.breaks.add(k + 1)
        elif bare.startswith("=") or (bare.startswith(">") and not bare.endswith("<")) or (fresh and bare.endswith("TO:") and bare == bare.upper()):
            out.prose.append(_blank(line))
        elif fresh and (_SCENE.match(bare) or (bare.startswith(".") and not bare.startswith(".."))):
            out.headings.append((2, by_bytes(bare).lstrip("."), k + 1))
            out.prose.append(_blank(line))
            out.breaks.add(k + 1)
        elif fresh and following and (bare.startswith("@") or (bare == bare.upper() and re.search(r"[^\W\d_]", bare))):
            speaking = True
            out.prose.append(_blank(line))
        else:
            out.prose.append(re.sub(r"^(\s*)[!>]|<\s*$|[*_]", lambda m: _blank(m[0]), line))
    return out


def paragraphs_of(found: Masked) -> list[dict]:
    """Paragraphs between blank lines and at breaks, each with the last heading before it; spoken lines are quoted."""
    out, held, section, heads = [], [], None, {line: k for k, (_, _, line) in enumerate(found.headings)}

    def flush() -> None:
        text = by_bytes("\n".join(held)).strip()
        if text:
            spoken = text.startswith(SPEECH)
            text = text.replace(SPEECH, "")
            out.append({"section": section, "text": f"“{text}”" if spoken else text})
        held.clear()

    for k, line in enumerate(found.prose):
        if k in found.breaks or not _bare(line):
            flush()
        if k + 1 in heads:
            flush()
            section = heads[k + 1]
        if _bare(line):
            held.append(line)
    flush()
    return out


def parse(source: str, kind: str) -> Masked:
    source = source.replace(FILL, " ")
    if kind == "markdown":
        return markdown(source)
    if kind == "fountain":
        return screenplay(source)
    return Masked(prose=source.split("\n"))


def parse_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    heading = pa.struct([("level", pa.int32()), ("title", pa.string()), ("line", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("prose", pa.string()), ("paras", pa.list_(pa.struct([("section", pa.int32()), ("text", pa.string())]))), ("headings", pa.list_(heading))])
    for batch in batches:
        rows = []
        for doc_id, kind, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = parse(source, kind or "plain")
            rows.append({"doc_id": doc_id, "source": source, "prose": by_characters("\n".join(found.prose)).replace(SPEECH, ""), "paras": paragraphs_of(found), "headings": [{"level": a, "title": b, "line": c} for a, b, c in found.headings]})
        yield pa.RecordBatch.from_pylist(rows, schema)
