"""Pages read as a browser's tokenizer reads them: tags, attributes, comments and raw
text, over bytes.

A batch of pages is one buffer.  Every `<` is taken for the beginning of a construct,
and the ends of all constructs are found at once by array searches: a comment ends
at the next `-->`, a tag goes on attribute by attribute until a `>` outside quotes, the
text of a script ends at its end tag.  Which of them are real follows from a chain:
the next construct begins at the first `<` after the end of this one.  So a page costs
as many array steps as its longest tag has attributes, whatever its length.

Constructs left open go on to the page's end and no further.  Blocks and line breaks
part words, other tags and comments don't.  Named and numeric entities are those of
the standard library's table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Elements that begin and end lines.
BLOCKS = """html head body frameset script noscript style meta link title frame noframes section nav aside hgroup header footer p
 h1 h2 h3 h4 h5 h6 ul ol pre div blockquote hr address figure figcaption form fieldset ins del dl dt dd li table caption thead tfoot
 tbody colgroup col tr th td video audio canvas details menu plaintext template article main center template textarea br""".split()
#: Elements whose content holds no tags: not shown, shown as it stands, shown with entities.
HIDDEN, AS_IT_STANDS, WITH_ENTITIES = ["script", "style"], ["xmp", "iframe", "noembed", "noframes"], ["textarea", "title"]

_RAW = [*HIDDEN, *AS_IT_STANDS, *WITH_ENTITIES]
_NAMES = np.array(sorted({*BLOCKS, *_RAW, "a", "base"}), "S12")
_OF = {name.decode(): n for n, name in enumerate(_NAMES)}
_BLOCK = np.array([name.decode() in BLOCKS for name in _NAMES] + [False])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ENTITY = re.compile(rb"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{0,31};?)")
_SLICE = 1 << 19
BATCH_BYTES = 4 << 20

PAGE = pa.struct([("text", pa.string()), ("title", pa.string()), ("hrefs", pa.list_(pa.string())), ("base", pa.string())])


def _class(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars.encode())] = True
    return mask


_SPACE = "\t\n\f\r "
_LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class _Next:
    """The next byte of a class from a place on, but no further than an end."""

    def __init__(self, data: np.ndarray):
        self.data, self.size = data, len(data)

    def among(self, found: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        found = np.append(np.flatnonzero(found) if found.dtype == bool else found, self.size)
        return lambda at, end: np.minimum(found[np.minimum(np.searchsorted(found, at), len(found) - 1)], end)

    def of(self, chars: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        return self.among(_class(chars)[self.data])

    def past(self, chars: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """The next byte outside a class: the place itself or where a run ends."""
        inside = _class(chars)[self.data]
        ends = self.among(np.flatnonzero(inside[:-1] & ~inside[1:]) + 1)
        return lambda at, end: np.where((at < end) & inside[np.minimum(at, self.size - 1)], ends(at, end), at)


def _name(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of each tag name among _NAMES, their count for another."""
    at = start[:, None] + np.arange(12)
    raw = np.where(at < end[:, None], _LOWER[data[np.minimum(at, len(data) - 1)]], np.uint8(0))
    raw[end - start > 12] = 0
    keys = np.ascontiguousarray(raw).view("S12").ravel()
    n = np.minimum(np.searchsorted(_NAMES, keys), len(_NAMES) - 1)
    return np.where(_NAMES[n] == keys, n, len(_NAMES))


def _value(raw: bytes) -> str:
    """An attribute's value; an entity without `;` before `=` or a letter is none."""

    def decoded(m: re.Match) -> bytes:
        after = raw[m.end() : m.end() + 1]
        if not m[0].endswith(b";") and not m[0].startswith(b"&#") and (after == b"=" or after.isalnum()):
            return m[0]
        return entities.unescape(m[0].decode()).encode("utf-8", "surrogatepass")

    return (_ENTITY.sub(decoded, raw) if b"&" in raw else raw).decode("utf-8", "replace")


def _pages(data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, str, list[str], str | None]]:
    """(text, title, hrefs, base) of each page, white space as it stands."""
    n_pages, size = len(offsets) - 1, len(data)
    if not size:
        return [("", "", [], None)] * n_pages
    find, raw = _Next(data), data.tobytes()
    lt = np.flatnonzero(data == 0x3C)
    page = np.searchsorted(offsets, lt, side="right") - 1
    end = offsets[page + 1]
    # a byte past the page's end is 0
    byte = lambda at, last: np.where(at < last, data[np.minimum(at, size - 1)], np.uint8(0))
    one, two, three = byte(lt + 1, end), byte(lt + 2, end), byte(lt + 3, end)
    to_gt = find.of(">")
    letter = _LETTER[one]
    closing = (one == 0x2F) & _LETTER[two]
    empty = (one == 0x2F) & (two == 0x3E)
    comment = (one == 0x21) & (two == 0x2D) & (three == 0x2D)
    bogus = ((one == 0x21) & ~comment) | (one == 0x3F) | ((one == 0x2F) & ~closing & ~empty & (lt + 2 < end))
    literal = ~(letter | closing | empty | comment | bogus)

    stop = np.where(literal, lt + 1, np.minimum(to_gt(lt, end) + 1, end))
    dashes = np.array([m.end() for m in re.finditer(rb"(?=--!?>)--", raw)], np.int64) - 2
    to_dashes = find.among(dashes)
    at = np.flatnonzero(comment)
    # the dashes of the opening may be those of the end
    closes = to_dashes(lt[at] + 2, end[at])
    stop[at] = np.where(closes < end[at], np.minimum(to_gt(closes, end[at]) + 1, end[at]), end[at])

    # tags: name, then attributes side by side
    tags = np.flatnonzero(letter | closing)
    name_end = find.of(_SPACE + "/>")(lt[tags] + 1 + closing[tags], end[tags])
    names = np.full(len(lt), len(_NAMES))
    names[tags] = _name(data, lt[tags] + 1 + closing[tags], name_end)
    whole = np.zeros(len(lt), bool)
    past_gap, past_space, to_attribute_end, to_plain_end = find.past(_SPACE + "/"), find.past(_SPACE), find.of(_SPACE + "/>="), find.of(_SPACE + ">")
    to_quote = {0x22: find.of('"'), 0x27: find.of("'")}
    values: dict[int, tuple[int, int]] = {}
    linking = np.isin(names, [_OF["a"], _OF["base"]]) & letter
    active, p = tags, name_end
    while len(active):
        last = end[active]
        p = past_gap(p, last)
        here = byte(p, last)
        shut = here == 0x3E
        stop[active[shut]], whole[active[shut]] = p[shut] + 1, True
        stop[active[p >= last]] = last[p >= last]  # cut off: no tag at all
        going = ~shut & (p < last)
        active, p, last = active[going], p[going], last[going]
        if not len(active):
            break
        start = p
        p = to_attribute_end(start + 1, last)
        equals = past_space(p, last)
        has = byte(equals, last) == 0x3D
        v = past_space(equals + 1, last)
        quote = byte(v, last)
        first, after, until = v.copy(), equals.copy(), v.copy()
        for sign, to in to_quote.items():
            rows = np.flatnonzero(has & (quote == sign))
            first[rows] = v[rows] + 1
            until[rows] = to(v[rows] + 1, last[rows])
            after[rows] = until[rows] + 1
            after[rows[until[rows] >= last[rows]]] = last[rows[until[rows] >= last[rows]]]
        rows = np.flatnonzero(has & (quote != 0x22) & (quote != 0x27))
        until[rows] = after[rows] = to_plain_end(v[rows], last[rows])
        href = np.flatnonzero(linking[active] & (p - start == 4))
        for k in href.tolist():
            if raw[start[k] : p[k]].lower() == b"href":
                values.setdefault(int(active[k]), (int(first[k]), int(until[k])) if has[k] else (0, 0))
        p = np.where(has, after, p)

    # raw text goes on to its end tag
    ends = np.flatnonzero(closing)
    of_end = _name(data, lt[ends] + 2, find.of(_SPACE + "/>")(lt[ends] + 2, end[ends]))
    terminated = find.of(_SPACE + "/>")(lt[ends] + 2, end[ends]) < end[ends]
    content = stop.copy()
    for name in _RAW:
        rows = np.flatnonzero(whole & letter & (names == _OF[name]))
        if len(rows):
            stop[rows] = find.among(lt[ends[(of_end == _OF[name]) & terminated]])(stop[rows], end[rows])

    following = np.searchsorted(lt, stop).tolist()
    chain, k = [], 0
    while k < len(following):
        chain.append(k)
        k = following[k]
    real = np.array(chain, np.int64)

    # what is shown: gaps between constructs, literal signs, some raw text
    change = np.zeros(size + 1, np.int32)
    change[0] = 1
    np.add.at(change, lt[real], -1)
    np.add.at(change, stop[real], 1)
    shown_raw = real[whole[real] & letter[real] & np.isin(names[real], [_OF[n] for n in (*AS_IT_STANDS, *WITH_ENTITIES)])]
    for rows in (real[literal[real]],):
        np.add.at(change, lt[rows], 1)
        np.add.at(change, stop[rows], -1)
    np.add.at(change, content[shown_raw], 1)
    np.add.at(change, stop[shown_raw], -1)
    shown = np.cumsum(change[:-1]) > 0
    out = data.copy()
    parts = real[whole[real] & _BLOCK[names[real]]]
    out[lt[parts]], shown[lt[parts]] = 0x20, True
    # a raw element's own end tag comes as a construct of its own

    plain = np.zeros(size + 1, np.int32)
    as_it_stands = real[whole[real] & letter[real] & np.isin(names[real], [_OF[n] for n in AS_IT_STANDS])]
    np.add.at(plain, content[as_it_stands], 1)
    np.add.at(plain, stop[as_it_stands], -1)
    decodable = shown & (np.cumsum(plain[:-1]) == 0)
    made: dict[bytes, bytes] = {}
    more: list[tuple[int, bytes]] = []
    for m in _ENTITY.finditer(raw):
        if decodable[m.start()]:
            a, b = m.span()
            b = min(b, int(offsets[np.searchsorted(offsets, a, side="right")]))
            sign = raw[a:b]
            if sign not in made:
                made[sign] = entities.unescape(sign.decode()).encode("utf-8", "replace")
            new = made[sign]
            fits = min(len(new), b - a)
            out[a : a + fits] = np.frombuffer(new[:fits], np.uint8)
            shown[a + fits : b] = False
            if fits < len(new):
                more.append((b, new[fits:]))
    counts = np.concatenate(([0], np.cumsum(shown)))
    text, bounds = out[shown], counts[offsets]
    if more:  # two entities are longer than their names
        at = np.repeat([counts[b] for b, _ in more], [len(x) for _, x in more])
        text = np.insert(text, at, np.frombuffer(b"".join(x for _, x in more), np.uint8))
        bounds = bounds + np.searchsorted(np.sort(np.repeat([b for b, _ in more], [len(x) for _, x in more])), offsets, side="right")
    shown_text = text.tobytes()
    texts = [shown_text[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    titles, hrefs, bases = [""] * n_pages, [[] for _ in range(n_pages)], [None] * n_pages
    titled: set[int] = set()
    for k in real[whole[real] & letter[real] & (names[real] == _OF["title"])].tolist():
        if int(page[k]) not in titled:
            titled.add(int(page[k]))
            titles[page[k]] = entities.unescape(raw[content[k] : stop[k]].decode("utf-8", "replace"))
    kept = set(real[whole[real]].tolist())
    for k, (a, b) in sorted(values.items()):
        if k in kept:
            if names[k] == _OF["a"]:
                hrefs[page[k]].append(_value(raw[a:b]))
            elif bases[page[k]] is None:
                bases[page[k]] = _value(raw[a:b])
    return list(zip(texts, titles, hrefs, bases, strict=True))


def read(pages: pa.Array) -> pa.Array:
    """The struct PAGE of each page; null for a null."""
    pages = pages.cast(pa.large_string())
    offsets = np.frombuffer(pages.buffers()[1], np.int64, len(pages) + 1, pages.offset * 8)
    buffer = pages.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    parts = [pa.array([], PAGE)]
    first = 0
    while first < len(pages):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _SLICE, side="right")) - 1)
        rows = _pages(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        # Python's objects live for a slice only
        parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PAGE, strict=True)], fields=list(PAGE)))
        first = last
    valid = pages.is_valid().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays(pa.concat_arrays(parts).flatten(), fields=list(PAGE), mask=pa.array(~valid))


def page(html: Column) -> Column:
    """(text, title, hrefs, base) of a column of pages.  A batch of them has BATCH_BYTES
    at most (or one page), whatever the table's size; this is a setting of the session
    and stays set."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return F.arrow_udf(read, "text string, title string, hrefs array<string>, base string")(html)
