"""Markdown notes: front matter, headings, tags, first paragraph, chunks, and re-assembly."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP, TAIL, FIRST_PARAGRAPH = 800, 120, 80, 200
EXPAND_DOCS, EXPAND_CHARS, OVERLAP_RANGE, PROBE, GAP, FULL_TEXT = 3, 1500, (10, 200), 40, "…", "全文"
# fixed value: what counts as a tag
TAG = r"(?<![#\w])#([\w一-鿿぀-ゟ゠-ヿ-]+)"
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def front_matter(text: str) -> tuple[str | None, str]:
    """(meta, body). An unclosed block is body; line ends become LF only when it is closed."""
    lines = re.split(r"\r\n|\r|\n", text)
    if lines[0].strip() == "---":
        for i in range(1, len(lines)):
            if lines[i].strip() in ("---", "..."):
                return "\n".join(lines[1:i]).strip() or None, "\n".join(lines[i + 1 :])
    return None, text


def headings(text: str) -> list[str]:
    return [m[2].strip() for m in _HEADING.finditer(front_matter(text)[1])]


def tags(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(TAG, text, re.ASCII)))


def first_paragraph(text: str, most: int = FIRST_PARAGRAPH) -> str:
    """The first run of plain lines, joined by spaces; headings and pictures are passed over."""
    lines = [x.strip() for x in text.splitlines()]
    if lines and lines[0] == "---":
        end = next((i for i in range(1, len(lines)) if lines[i] in ("---", "...")), len(lines))
        lines = lines[end + 1 :]
    got = ""
    for n, line in enumerate(lines):
        if len(got) >= most or (not line and got):
            break
        if line and line[0] not in "#!":
            got += line + " "
    return got.strip()[:most]


def sections(text: str, path: str) -> Iterator[tuple[str, str]]:
    """(heading path, body) in order; text before the first heading stands under the path."""
    marks = list(_HEADING.finditer(text))
    if not marks:
        yield path, text
        return
    if before := text[: marks[0].start()].strip():
        yield path, before
    above: dict[int, str] = {}
    for m, end in zip(marks, [x.start() for x in marks[1:]] + [len(text)]):
        level = len(m[1])
        above = {k: v for k, v in above.items() if k < level} | {level: m[2].strip()}
        yield " > ".join([path, *above.values()]), text[m.end() : end].strip()


def paragraphs(body: str) -> list[str]:
    """Broken at two or more blank lines outside fences; a single blank line is kept."""
    out: list[str] = []
    held, gap, fenced = "", 0, False
    for line in body.splitlines() or [""]:
        fenced ^= line.lstrip().startswith("```")
        if not line.strip() and not fenced:
            gap += 1
            if gap > 1 and held.strip():
                out.append(held)
                held = ""
            continue
        if held.strip() and gap == 1:
            held += "\n"
        held += ("\n" if held else "") + line
        gap = 0
    return out + [held] if held.strip() else out


def windows(text: str, size: int = MAX_CHARS, step: int = MAX_CHARS - OVERLAP) -> list[str]:
    """Fixed windows; the last takes what is left when at most ``size`` remain."""
    starts = [0]
    while len(text) - starts[-1] > size:
        starts.append(starts[-1] + step)
    return [text[s : s + size] for s in starts]


def packed(body: str) -> list[str]:
    """Chunks of a long section: paragraphs packed up to MAX_CHARS, each chunk starting with the end of the last."""
    out: list[str] = []
    held = ""
    for p in paragraphs(body):
        if held and len(held) + (2 if len(p) <= MAX_CHARS else MAX_CHARS) + len(p) > MAX_CHARS:
            out.append(held.strip())
            held = held[-OVERLAP:] + "\n\n"
        *whole, rest = windows(p)
        out += [w.strip() for w in whole]
        held += rest + "\n\n"
    return out + [held.strip()] if held.strip() else out


def chunks(text: str, path: str) -> list[tuple[str, str]]:
    """(heading path, text) of a note; chunks of the front matter come last."""
    if not text.strip():
        return []
    meta, body = front_matter(text)
    out, before = [], ""
    for heading, section in sections(body, path):
        tail = before[-TAIL:].strip()
        carried = f"{tail}\n\n{section}" if tail else section
        out += [(heading, c) for c in ([carried.strip()] if len(carried) <= MAX_CHARS else packed(carried)) if c.strip()]
        before = section
    if meta:
        out += [(path, c) for c in ([meta] if len(meta) <= MAX_CHARS else packed(meta))]
    return out


def joint(before: str, after: str) -> int:
    """Length of the longest end of ``before`` that starts ``after``, within OVERLAP_RANGE."""
    low, high = OVERLAP_RANGE
    return next((k for k in range(min(high, len(before), len(after)), low - 1, -1) if before.endswith(after[:k])), 0)


def reassembled(parts: list[tuple[str, str]], anchor: int, most: int = EXPAND_CHARS) -> str:
    """Chunks as running text around the anchor, each overlap once, gaps marked."""
    pieces = []
    for i, (heading, text) in enumerate(parts):
        body = text[joint(parts[i - 1][1], text) :].lstrip() if i else text
        title = heading.rpartition(" > ")[2] if " > " in heading else ""
        pieces.append(f"## {title}\n{body}" if title and (not i or parts[i - 1][0] != heading) else body)
    lo = hi = min(max(anchor, 0), len(pieces) - 1)
    size, forward = len(pieces[lo]), True
    while lo > 0 or hi < len(pieces) - 1:
        ahead = hi < len(pieces) - 1 and (forward or lo == 0)
        nxt = hi + 1 if ahead else lo - 1
        forward = not forward
        if size + len(pieces[nxt]) > most:
            break
        size += len(pieces[nxt])
        lo, hi = min(lo, nxt), max(hi, nxt)
    shown = ([GAP] if lo else []) + pieces[lo : hi + 1] + ([GAP] if hi < len(pieces) - 1 else [])
    return "\n\n".join(shown)[:most]


def anchor_of(parts: list[tuple[str, str]], snippet: str) -> int:
    probe = snippet.strip()[:PROBE]
    return next((i for i, (_, t) in enumerate(parts) if probe in t), 0) if probe else 0


def chunk_notes(notes: DataFrame) -> DataFrame:
    """(doc_id, idx, heading_path, text) of notes (doc_id, relative_path, content). Notes reach Python by the hundred,
    as Spark pickles them, and not by the ten thousand as in an Arrow batch: a worker holds a
    hundred notes and their chunks, however large the table."""
    made = F.udf(lambda c, p: chunks(c or "", p or ""), "array<struct<heading_path:string,text:string>>", useArrow=False)
    each = notes.select("doc_id", F.posexplode(made("content", "relative_path")).alias("idx", "_c"))
    return each.select("doc_id", "idx", "_c.heading_path", "_c.text")


def window_chunks(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(doc_id, idx, text) and what ``keep`` names of the document: fixed windows as built-in expressions."""
    step = MAX_CHARS - OVERLAP
    last = f"greatest(0, ceil((length({text}) - {MAX_CHARS}) / {step}D))"
    return docs.where(F.length(text) > 0).select("doc_id", F.expr(f"explode(sequence(0, int({last})))").alias("idx"), text, *keep).select("doc_id", "idx", *keep, F.expr(f"substring({text}, idx * {step} + 1, {MAX_CHARS})").alias("text"))


def headings_of(content: Column) -> Column:
    return F.udf(lambda x: headings(x or ""), "array<string>", useArrow=True)(content)


def first_paragraph_of(content: Column) -> Column:
    return F.udf(lambda x: first_paragraph(x or ""), "string", useArrow=True)(content)


def tags_of(content: Column) -> Column:
    """Tags as built-in expressions; the JVM's word characters are ASCII."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(TAG), 1))


def embedding_text(heading_path: Column, text: Column) -> Column:
    return F.concat(F.regexp_replace(heading_path, r"(?i)\.md(?= > |$)", ""), F.lit("\n"), text)
