"""The chunker as one loop over a document, which the library's is held against."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from mnemara.operators.chunking import ChunkOptions

_CJK = re.compile("[ᄀ-ᇿ⺀-꓏ꡀ-꡿가-힯豈-﫿︰-﹏･-ￜ]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
LEAST_BUDGET = 32


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text) + len(_ASTRAL.findall(text))


def measure(text: str) -> tuple[int, int]:
    """How many CJK characters, and how many other UTF-16 units."""
    if text.isascii():
        return 0, len(text)
    cjk = len(_CJK.findall(text))
    return cjk, units(text) - cjk


def tokens(cjk: int, rest: int) -> int:
    return cjk + -(-rest // 3)


def estimate(text: str) -> int:
    return tokens(*measure(text))


def blocks(md: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, text, heading path)`` of each block that isn't a heading."""
    path: list[tuple[int, str]] = []
    held: list[str] = []
    kind, fence = "para", ""

    def block() -> Iterator[tuple[str, str, str]]:
        if held:
            yield kind, "\n".join(held), " > ".join(h for _, h in path)
            held.clear()

    for line in md.replace("\r\n", "\n").split("\n"):
        bare = line.strip()
        if fence:
            held.append(line)
            if bare.startswith(fence):
                fence = ""
                yield from block()
        elif bare.startswith(("```", "~~~")):
            yield from block()
            kind, fence, held = "code", bare[:3], [line]
        elif m := re.match(r"(#{1,6})\s+(?=\S)", line):
            yield from block()
            path = [h for h in path if h[0] < len(m[1])] + [(len(m[1]), line[m.end() :].strip())]
        elif not bare:
            yield from block()
        else:
            now = "table" if bare.startswith("|") else "para"
            if now != kind:
                yield from block()
            kind = now
            held.append(line)
    yield from block()


def sentences(text: str) -> list[str]:
    """A text cut after every run of stops that white space follows."""
    ends = [m.end() for m in re.finditer(r"(?<=[.!?])\s", text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if a < b]


def halves(text: str, budget: int) -> list[str]:
    """A unit without boundaries, halved until its parts fit; pairs of surrogates stay whole as Python has none."""
    if estimate(text) <= budget or len(text) < 2:
        return [text]
    middle = -(-len(text) // 2)
    return halves(text[:middle], budget) + halves(text[middle:], budget)


def slices(text: str, limit: int) -> list[str]:
    """A unit without boundaries in parts of up to ``limit`` UTF-16 units, of a character at least."""
    out, start, size = [], 0, 0
    for i, c in enumerate(text):
        n = 2 if c > "￿" else 1
        if size + n > limit and i > start:
            out.append(text[start:i])
            start, size = i, 0
        size += n
    return [*out, text[start:]]


def packed(parts: list[str], fits: Callable[[int, int], bool], hard: Callable[[str], list[str]]) -> Iterator[tuple[str, bool]]:
    """Consecutive parts joined as far as they fit, and the hard cuts (True) of those that don't by themselves; by running measures."""
    now: list[str] = []
    cjk = rest = 0
    for p in parts:
        a, b = measure(p)
        if now and not fits(cjk + a, rest + b):
            yield "".join(now), False
            now, cjk, rest = [], 0, 0
        if fits(a, b):
            now.append(p)
            cjk, rest = cjk + a, rest + b
        else:
            yield from ((x, True) for x in hard(p))
    if now:
        yield "".join(now), False


def raw_parts(md: str, options: ChunkOptions) -> Iterator[tuple[str, str, list[str]]]:
    """``(text, heading path, flags)`` of what blocks are packed or cut to."""
    limit = options.max_chars
    held: list[str] = []
    size, under = 0, ""

    def flush() -> Iterator[tuple[str, str, list[str]]]:
        nonlocal size
        if text := "\n\n".join(held).strip():
            yield text, under, []
        held.clear()
        size = 0

    for kind, text, path in blocks(md):
        n = units(text)
        if path != under or n > limit or held and size + n + 2 > limit:
            yield from flush()
            under = path
        if n > limit:
            cut = sentences(text) if kind == "para" else [f"{line}\n" for line in text.split("\n")]
            for part, hard in packed(cut, lambda cjk, rest: cjk + rest <= limit, lambda u: slices(u, limit)):
                if part.strip():
                    yield part if hard else part.strip(), path, [f"force-split-{kind}" + "+hard-cut" * hard]
            continue
        size += n + (2 if held else 0)
        held.append(text)
    yield from flush()


def tail(text: str, n: int) -> str:
    """The last ``n`` UTF-16 units, from after the first end of a sentence or line in them if there is one."""
    if units(text) <= n:
        return text
    end = text[-n:]
    while units(end) > n:
        end = end[1:]
    m = re.search(r"[.!?]\s|\n", end)
    return (end[m.start() + 1 :] if m else end).strip()


def breadcrumb(path: str, budget: int) -> tuple[str, bool]:
    """The headings above a chunk, their tail kept within half the budget, and whether they were cut."""
    line, cut = f"{path}\n\n" if path else "", False
    while line and estimate(line) > budget / 2:
        line, cut = line[max(32, len(line) // 4) :], True
    return line, cut


def chunk(md: str, options: ChunkOptions = ChunkOptions()) -> Iterator[dict]:
    """The chunks of one document."""
    place, before = 0, ("", None)
    for text, path, flags in raw_parts(md, options):
        lead = tail(before[0], options.overlap_chars) if before[1] == path and options.overlap_chars > 0 else ""
        before = (text, path)
        crumb, cut = breadcrumb(path, options.token_budget)
        content = f"{lead}\n\n{text}" if lead else text
        marks = [*flags, *["overlap"] * bool(lead), *["breadcrumb-truncated"] * cut]
        budget = max(options.token_budget - estimate(crumb), LEAST_BUDGET)
        parts = [content]
        if estimate(content) > budget:
            marks.append("token-split")
            cuts = [f"{line}\n" for line in content.split("\n")] if "\n" in content else sentences(content)
            parts = [p.rstrip() for p, _ in packed(cuts, lambda cjk, rest, b=budget: tokens(cjk, rest) <= b, lambda u, b=budget: halves(u, b)) if p.strip()]
        for p in parts:
            n = units(p)
            quality = [("tiny", n < options.min_chars), ("oversized", n > options.max_chars * 1.15), ("mid-sentence", not re.search(r'[.!?:)\]`"]$', p.strip()))]
            yield {
                "position": place, "content": p, "embedded_content": crumb + p, "heading_path": path, "char_len": n, "tokens": estimate(p),
                "flags": marks + [f for f, on in quality if on],
            }
            place += 1
