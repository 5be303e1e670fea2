"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of a host.

A page's stream of tags and text slots is folded (a unit that repeats becomes one repeated group). The folded streams
of a host are aligned; what one side lacks becomes optional, repeated groups absorb single units, and what remains in
common are tags and text slots. Few streams are aligned in one place; the wrappers they give are aligned with each
other in turn, as a tree, until a host has one. Its slots and groups are labelled once for the host: texts that all
pages have at a place are the template's, and groups that repeat links alone are menus. A page is read by aligning its
own stream with the wrapper; names of elements and landmarks decide on what the wrapper leaves open.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, settled, ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<", re.S)
_SIGN = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements by their place in HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
APART = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
# Names that authors give to what isn't the article, and names that say nothing of what they hold. Nothing fixes these:
# they decide only on texts that differ from page to page, which no wrapper can tell from the article's.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "reply", "replies", "footer", "header", "masthead", "toolbar", "pagination", "pager", "form", "search"}
EMPTY_NAMES = {"area", "bar", "block", "body", "bottom", "box", "container", "content", "group", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel", "posts", "primary", "reader", "right", "row", "section", "secondary", "site", "slot", "text", "thread", "title", "top", "unit", "user", "wrap", "wrapper", ""}
_CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SPLIT = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"\w")


def stream(html: str) -> list[tuple[str, str, str]]:
    """(kind, name, signature or text) of tags and texts, kind one of ``open``, ``close``, ``text``. Comments,
    declarations and the insides of scripts, styles and the like are left out."""
    out, at, n = [], 0, len(html)
    lower = None
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        text = m.group()
        if m.group(2):
            name = m.group(2).lower()
            if m.group(1):
                out.append(("close", name, ""))
                continue
            sign = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in _SIGN.findall(m.group(3)))
            if re.search(r"\s(hidden|aria-hidden\s*=\s*[\"']?true)", m.group(3)):
                sign += " hidden"
            if name in RAW and not m.group(3).rstrip().endswith("/"):
                lower = lower if lower is not None else html.lower()
                end = lower.find(f"</{name}", at)
                at = n if end < 0 else (html.find(">", end) + 1 or n)
                continue
            out.append(("open", name, sign))
            if m.group(3).rstrip().endswith("/") and name not in VOID and name not in BLOCKS:
                out.append(("close", name, ""))
        elif not text.startswith("<!") and not text.startswith("<?"):
            out.append(("text", "", text))
    return out


def apart(name: str, sign: str, inside: bool) -> bool:
    """Whether an element by its name, role, class or id isn't part of an article. ``inside`` one, a header is the
    article's own. A class or id counts if it is made of ``NAMES`` and ``EMPTY_NAMES`` alone: "related-work" and
    "article-header" say nothing, "cookie-notice" does."""
    if name in APART and not (inside and name == "header") or sign.endswith("hidden"):
        return True
    for part in sign.split(" "):
        key, _, value = part.rpartition("=") if "=" in part else ("", "", part)
        if key == "role" and value in ROLES:
            return True
        words = {w.rstrip("0123456789") for w in _SPLIT.split(value.lower())}
        if key != "role" and words & NAMES and words <= NAMES | EMPTY_NAMES and not (inside and words <= {"header"} | EMPTY_NAMES):
            return True
    return False


def walk(tokens: list[tuple[str, str, str]]) -> tuple[list[str], list[dict]]:
    """Nodes of the stream for alignment (a text's node names the element around it), and its text slots in order: the node's place, the text, the number of the
    block, whether an element around it is apart, and the landmark (article, main) around it."""
    nodes: list[str] = []
    slots: list[dict] = []
    stack: list[tuple[str, bool, int, str]] = []  # name, apart, landmark number, sign
    block, landmarks = 0, 0
    for kind, name, value in tokens:
        if kind == "text":
            if not nodes or not nodes[-1].startswith("#"):
                nodes.append(f"#{stack[-1][0] if stack else ''}")
            mark = next((x[2] for x in stack if x[2]), 0)
            inner = sum(1 for x in stack if x[0] == "article")
            slots.append({"at": len(nodes) - 1, "text": value, "block": block, "apart": any(x[1] for x in stack), "mark": mark, "nested": inner > 1, "path": "/".join(x[0] for x in stack)})
            continue
        if name in BLOCKS:
            block += 1
        elif name == "br" and slots:
            slots[-1]["text"] += " "
        if kind == "open":
            if name in BLOCKS or name in _CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    over = stack[i][0]
                    if over in _CLOSES and name in _CLOSES[over]:
                        del stack[i:]
                        break
                    if over in BLOCKS:
                        break
            nodes.append(f"<{name} {value}>")
            if name not in VOID:
                mark = 0
                if name in ("article", "main") or "role=main" in value:
                    landmarks += 1
                    mark = landmarks
                stack.append((name, apart(name, value, any(x[0] == "article" for x in stack)), mark, value))
        elif name not in VOID:
            nodes.append(f"</{name}>")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
    return nodes, slots


def fold(nodes: list[str], longest: int = 64) -> tuple[list, list[int]]:
    """Repeated units of up to ``longest`` nodes as one node ("+", unit...), innermost first; and for each original node the place it went to."""
    seq, where = list(nodes), [[i] for i in range(len(nodes))]
    for size in range(1, longest + 1):
        if not any(map(eq, seq, seq[size:])):
            continue
        out, places, i = [], [], 0
        while i < len(seq):
            if i + size >= len(seq) or seq[i] != seq[i + size]:
                out.append(seq[i])
                places.append(where[i])
                i += 1
                continue
            unit = seq[i : i + size]
            k = 1
            while len(unit) == size and seq[i + k * size : i + (k + 1) * size] == unit:
                k += 1
            if k > 1 and not (size == 1 and isinstance(unit[0], tuple)):
                out.append(("+", *unit))
                places.append([x for w in where[i : i + k * size] for x in w])
            elif k > 1:
                out.append(unit[0])
                places.append([x for w in where[i : i + k] for x in w])
            else:
                k = 0
                out.append(seq[i])
                places.append(where[i])
                i += 1
            i += k * size
        seq, where = out, places
    to = [0] * len(nodes)
    for j, w in enumerate(where):
        for i in w:
            to[i] = j
    return seq, to


def _absorb(seq: list, other: list) -> tuple[list, list[int]]:
    """Single units of ``seq`` that ``other`` repeats, as repeated groups; and for each node the place it went to."""
    known, to = set(seq), list(range(len(seq)))
    for node in dict.fromkeys(x for x in other if isinstance(x, tuple) and x not in known):
        unit, i = list(node[1:]), 0
        while i + len(unit) <= len(seq):
            if seq[i : i + len(unit)] == unit:
                seq = [*seq[:i], node, *seq[i + len(unit) :]]
                to = [x if x < i else max(i, x - len(unit) + 1) for x in to]
            i += 1
    return seq, to


def align(wrapper: list[list], other: list[list]) -> list[list]:
    """The wrapper, nodes as [node, optional], widened so that it also matches what ``other`` does."""
    theirs, loose = _absorbed(other, [x[0] for x in wrapper])
    names, flags = _absorbed(wrapper, theirs)
    out: list[list] = []
    for tag, a, b, c, d in SequenceMatcher(None, names, theirs, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [[names[a + k], flags[a + k] or loose[c + k]] for k in range(b - a)]
        else:
            out += [[names[i], True] for i in range(a, b)] + [[theirs[i], True] for i in range(c, d)]
    return out


def _absorbed(wrapper: list[list], other: list) -> tuple[list, list[bool]]:
    """Nodes of a wrapper in which units that ``other`` repeats are groups, and whether each is optional."""
    names, to = _absorb([x[0] for x in wrapper], other)
    flags = [True] * len(names)
    for (_, optional), k in zip(wrapper, to, strict=True):
        flags[k] &= optional
    return names, flags


def places(names: list, seq: list) -> list[int]:
    """The wrapper's place of each node of ``seq``, -1 where it has none."""
    seq, to = _absorb(seq, names)
    found = [-1] * len(seq)
    for a, b, size in SequenceMatcher(None, names, seq, autojunk=False).get_matching_blocks():
        for k in range(size):
            found[b + k] = a + k
    return [found[i] for i in to]


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    return m.group(1).lower() if m else ""


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", unescape(text)).strip()


def _digest(data: str | bytes) -> int:
    data = data if isinstance(data, bytes) else data.encode(errors="replace")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


_SEEN = "host long, shape long, stream binary, slot int, digest long, content long"


def _pack(x) -> bytes:
    return zlib.compress(json.dumps(x).encode())


def _unpack(data: bytes) -> list:
    return [_node(x) for x in json.loads(zlib.decompress(data))]


def _node(x):
    return tuple(_node(y) for y in x) if isinstance(x, list) else x


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the folded stream (slot -1) for each page, and one for each text with words at a place of it."""
    for batch in batches:
        rows: list[tuple] = []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            nodes, slots = walk(stream(html or ""))
            seq, to = fold(nodes)
            text = json.dumps(seq)
            host, plain = host_of(url), [_plain(s["text"]) for s in slots]
            host, shape, content = _digest(host), _digest(f"{host} {text}"), _digest("\0".join(plain))
            rows.append((host, shape, zlib.compress(text.encode()), -1, None, None))
            rows += [(host, shape, None, k, v, content) for k, v in {(to[s["at"]], _digest(t)) for s, t in zip(slots, plain, strict=True) if _WORD.search(t)}]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["host", "shape", "stream", "slot", "digest", "content"])


def _merge(key: tuple, found: pa.Table) -> pa.Table:
    """One wrapper of the wrappers of a host's group, those of most pages first."""
    wrapper: list = []
    for row in sorted(found.to_pylist(), key=lambda r: (-r["pages"], r["name"])):
        part = [list(x) for x in _unpack(row["part"])]
        wrapper = align(wrapper, part) if wrapper else part
    data = _pack(wrapper)
    return pa.table({"host": pa.array([key[0].as_py()], pa.int64()), "name": pa.array([_digest(data)], pa.int64()), "part": pa.array([data], pa.binary()), "pages": pa.array([sum(found.column("pages").to_pylist())], pa.int64())})


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams as wrappers without optional nodes."""
    for batch in batches:
        parts = [_pack([[x, False] for x in _unpack(v)]) for v in batch.column("stream").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(parts, pa.binary()), batch.column("pages")], names=["host", "name", "part", "pages"])


def _tree(parts: DataFrame, fan: int) -> DataFrame:
    """host and part, the wrapper of all wrappers (host, name, part, pages) of a host. ``fan`` of them, about, are merged
    in one place; rounds follow until each host has one."""
    ship(parts.sparkSession)
    while True:
        count = parts.groupBy("host").agg(F.count("*").alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return parts
        # in a host's last rounds one group takes all that is left
        groups = F.when(F.col("n") <= 2 * fan, F.lit(1)).otherwise(F.ceil(F.col("n") / fan))
        dealt = parts.join(count, "host").withColumn("g", F.pmod(F.xxhash64("name"), groups))
        parts = materialize(dealt.groupBy("host", "g").applyInArrow(_merge, "host long, name long, part binary, pages long"), "wrapper-parts")


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper's place of every node of a stream that has one."""
    for batch in batches:
        rows: list[tuple] = []
        for host, shape, data, part, pages in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "stream", "part", "pages")), strict=True):
            rows += [(host, shape, slot, k, pages) for slot, k in enumerate(places([x[0] for x in _unpack(part)], _unpack(data))) if k >= 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["host", "shape", "slot", "place", "pages"])


def wrappers(pages: DataFrame, fan: int = 32) -> DataFrame:
    """host (a hash of its name), part (the wrapper's nodes) and fixed: places and digests of texts that all pages of the
    host with that place have there, in a repeated group among others; there must be more than two such pages, and not
    all with the same texts.

    Streams and texts are counted by shape and place with partial sums first. A host's different streams are aligned as
    a tree (:func:`_tree`), its texts are counted by place as a table, and texts that it has on two pages or fewer, which
    can't be fixed, go early; so no task holds more of a host than its wrapper and ``fan`` parts of it."""
    rows = materialize(in_arrow(pages.select("url", "html"), _streams, _SEEN), "streams")
    shapes = rows.where("slot < 0").groupBy("host", "shape").agg(F.min("stream").alias("stream"), F.count("*").alias("pages"))
    shapes = materialize(shapes, "shapes")
    known = _tree(in_arrow(shapes.select("host", "shape", "stream", "pages"), _alone, "host long, name long, part binary, pages long"), fan).select("host", "part")
    put = materialize(in_arrow(shapes.join(known, "host"), _put, "host long, shape long, slot int, place int, pages long"), "places")
    texts = rows.where("slot >= 0").groupBy("host", "shape", "slot", "digest").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    texts = materialize(texts, "texts")
    often = materialize(texts.groupBy("host", "digest").agg(F.sum("n").alias("all")).where("all > 2").select("host", "digest"), "often")
    there = texts.join(often, ["host", "digest"], "left_semi").join(put.drop("host", "pages"), ["shape", "slot"])
    there = there.groupBy("host", "place", "digest", "shape").agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    there = there.groupBy("host", "place", "digest").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    total = put.select("host", "shape", "place", "pages").distinct().groupBy("host", "place").agg(F.sum("pages").alias("pages"))
    fixed = there.join(total, ["host", "place"]).where("n = pages and n > 2 and low != high")
    fixed = fixed.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("fixed"))
    return known.join(fixed, "host", "left")


def _links(node) -> bool:
    """Whether a group repeats nothing but links: every text of its unit lies in one."""
    if not isinstance(node, tuple):
        return False
    depth, texts = 0, 0
    for x in _flat(node):
        depth += x.startswith("<a ") - (x == "</a>")
        if x.startswith("#"):
            texts += 1
            if not depth:
                return False
    return texts > 0


def _flat(node) -> Iterator[str]:
    for x in node[1:]:
        yield from _flat(x) if isinstance(x, tuple) else (x,)


def main_text(html: str | None, wrapper: list | None = None, fixed: dict[int, set[int]] | None = None) -> str:
    """The article's blocks, one a line. The wrapper decides first: texts that it labels as fixed are never read, nor are
    groups that repeat links alone; marks without words go with the rest of their block. Names of elements decide on what
    is left. If that has landmarks (article, main), those with at least a quarter of the longest one's text hold articles;
    others are teasers."""
    nodes, slots = walk(stream(html or ""))
    seq, to = fold(nodes)
    menus = {k for k, x in enumerate(seq) if _links(x)}
    good = [s for s in slots if not s["apart"] and not s["nested"] and to[s["at"]] not in menus]
    if wrapper and fixed:
        at = places([x[0] for x in wrapper], seq)
        gone = [_digest(_plain(s["text"])) in fixed.get(at[to[s["at"]]], ()) for s in good]
        lost = {s["block"] for s, g in zip(good, gone, strict=True) if g}
        good = [s for s, g in zip(good, gone, strict=True) if not g]
        lost -= {s["block"] for s in good if s["block"] in lost and _WORD.search(_plain(s["text"]))}
        good = [s for s in good if s["block"] not in lost]
    marks: dict[int, int] = {}
    for s in good:
        if s["mark"]:
            marks[s["mark"]] = marks.get(s["mark"], 0) + len(_plain(s["text"]))
    if marks and max(marks.values()):
        least = max(marks.values()) / 4
        good = [s for s in good if s["mark"] and marks[s["mark"]] >= least]
    blocks: dict[int, list[str]] = {}
    for s in good:
        blocks.setdefault(s["block"], []).append(s["text"])
    lines = [_plain("".join(x)) for x in blocks.values()]
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int | None, tuple] = {None: (None, None)}
    for batch in batches:
        texts = []
        hosts, parts, fixed = batch.column("host"), batch.column("part"), batch.column("fixed")
        for i, html in enumerate(batch.column("html").to_pylist()):
            host = hosts[i].as_py() if parts[i].is_valid else None
            if host not in known:
                if len(known) > 256:
                    known = {None: (None, None)}
                labels: dict[int, set[int]] = {}
                for x in fixed[i].as_py() or ():
                    labels.setdefault(x["place"], set()).add(x["digest"])
                known[host] = (_unpack(parts[i].as_py()), labels)
            texts.append(main_text(html, *known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([_digest(host_of(u)) for u in batch.column("url").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=[*batch.schema.names, "host"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a null url belongs to the host "". Rows may repeat. Pages of a host with a
    single page are read by the labels of elements alone. Pages are joined with their host's wrapper; a host with most
    of the pages is a skewed join, which Spark splits. Other columns are ignored; an empty table gives an empty one."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = settled(lambda: wrappers(rows), "wrappers")
    placed = in_arrow(rows, _hosts, "page_id long, url string, html string, host long").join(known, "host", "left")
    return in_arrow(placed.select("page_id", "url", "html", "host", "part", "fixed"), _extract, "page_id long, url string, text string, n_chars long")
