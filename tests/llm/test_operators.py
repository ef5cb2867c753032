"""Every operator against brute force on small tables, with nulls, empty and long texts, ties,
repeated rows, empty tables and further columns whose names clash."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from vistaquery.llm import bpe_dp, cascade, ctw, html_text, jaccard_join, packing, rp_forest, substring, token_store, warc, work
from vistaquery.llm.components import components, forest
from vistaquery.llm import words as words_module
from vistaquery.llm.encoder import ChunkEncoder

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, n_words long, kept string, part int, ids string, sig long"
EMPTY = []


def words(text):
    return (text or "").encode().split()


def corpus(seed=0, n=60):
    """Random texts of few words, with copies, near copies, shared passages and the special cases."""
    rnd = random.Random(seed)
    vocabulary = [rnd.choice("abcdefgh") + "".join(rnd.choice("aeiounrst") for _ in range(rnd.randint(0, 5))) for _ in range(150)] + ["é", "ß,", "The", "the"]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage = text(30)
    out = [text(rnd.randint(1, 120)) for _ in range(n)]
    for k in range(0, n, 5):
        own = out[k].split()
        own[len(own) // 2] = "changed"
        out.append(" ".join(own))
        out.append(out[k])
        out.append(text(10) + "\n" + passage + "\n" + text(rnd.randint(0, 9)))
    out += [None, "", " \t\n", "one", "one two three", "One  two\nthree", passage + " " + passage, text(6000), "\x1c odd\x85 white\xa0space "]
    rows = [(k, t) for k, t in enumerate(out)]
    rnd.shuffle(rows)
    return rows + [rows[0], (None, "a null id with words"), (None, None)]


def frame(spark, rows):
    """With further columns that clash with those that operators add."""
    return spark.createDataFrame([(i, t, -1, "x", -2, "y", -3) for i, t in rows], SCHEMA).repartition(3)


def key(row):
    return tuple((x is not None, x) if not isinstance(x, float) else (True, round(x, 6)) for x in row)


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


# --- 1: HTML ---


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>a</p><p>b", "a\n\nb"), ("<p>a<div>b</div>c", "a\n\nb\nc"), ("a <b> b </b> c", "a b c"), ("x<br><br>y", "x\n\ny"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"), ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<table><tr><th>k<th>value<tr><td>long one<td>2</table>", "k         value\nlong one  2"), ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab    c\nd  e  f"),
        ("<head><title>t</title></head><body>a<script>x<p></script><style>y</style>b", "ab"), ("a<div hidden>b</div><p style='color:red; DISPLAY : none'>c</p>d", "ad"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"), ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"), ("1 &lt; 2 &amp; 3 < 4", "1 < 2 & 3 < 4"),
        ("<details><summary>s</summary>x</details><dialog>y</dialog>", "s"), ("<!-- <p>a --><![CDATA[x]]>b<a href='unended", "b"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("</p>a</div>b", "ab"),
    ],
)
def test_html(html, text):
    assert html_text.html_to_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "So x=1 holds"),
        ("<math><semantics><mi>y</mi><annotation encoding='application/x-tex'>tex</annotation></semantics></math>z", "yz"),
        ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd>3</mtd><mtd>4</mtd></mtr></mtable></math>", "1 2\n3 4"),
        ("a<svg><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>u</text></defs><text>label</text><text x='1'>two</text></svg>b", "a\nlabel\ntwo\nb"),
        ("<svg><title/><defs/><path d='x'/><text>shown</text></svg>b", "shown\nb"),
        ("<svg><text><![CDATA[1 &lt; > 2]]></text></svg>", "1 &lt; > 2"),
        ("<svg><text display='none'>a</text><text visibility=hidden>b</text><text>c</text></svg>", "c"),
        ("<svg><foreignObject><p>html<p>text</foreignObject></svg>", "html\n\ntext"),
        ("<svg><defs><p>after", "after"), ("<desc>d</desc><text>e</text><annotation>f", "def"), ("<svg><style>s</style><script>s</script></svg>x", "x"),
    ],
)
def test_html_shows_svg_and_math(html, text):
    assert html_text.html_to_text(html) == text
    assert html_text.html_to_text("<svg>" + "<g>" * 50_000 + "<text>x") == "x"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><td><p>one</p><p>two</p><ul><li>a</li><li>b</li></ul><pre>x\n  y</pre></td><td>side</table>", "one  side\n\ntwo\n\n- a\n- b\n\nx\n  y"),
        ("<table><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"), ("<table><tr><td rowspan=2>A<br>D<br>E<td>B<tr><td>C</table>", "A  B\nD  C\nE"),
        ("<table><tr><td>" + "w" * 61 + "<td>next<tr><td>a<td>b</table>", "w" * 61 + "\n   next\na  b"), ("<table><tr><td>" + "w" * 60 + "<td>next<tr><td>a<td>b</table>", "w" * 60 + "  next\na" + " " * 61 + "b"),
        ("<table><tr><td colspan=1000>h<td>z<tr><td>a<td>b<td>c</table>", "h        z\na  b  c"), ("<table><tr><td colspan=3>a longer head<td>z<tr><td>a<td>b<td>c<td>d</table>", "a longer head  z\na  b  c        d"),
        ("<table><tr><th>k<th>v<tr><td><table><tr><td>in<td>ner<tr><td>2<td>3</table><td>x</table>", "k        v\nin  ner  x\n2   3"),
        ("<table><tbody><tr><td rowspan=9>A<td>B</tbody><tbody><tr><td>C<td>D</table>", "A  B\nC  D"), ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D</table>", "A  B\n   C\n   D"),
        ("<table><tr><td colspan='2px'>a<td colspan=" + "9" * 5000 + ">b<td rowspan=x>c<tr><td>d</table>", "a  b  c\nd"), ("<ul><li><table><tr><td>a<td>b<tr><td>c<td>d</table></ul>", "- a  b\n  c  d"),
        ("<pre><table><tr><td>a  b<td>c</table></pre>", "a  b  c"), ("<table><tr><td style='visibility:hidden'>a<td>b<tr><td hidden>c<td>d</table>", "   b\nd"),
    ],
)
def test_html_tables(html, text):
    assert html_text.html_to_text(html) == text


@pytest.mark.parametrize("seed", range(40))
def test_html_tables_against_their_grid(seed):
    """Every line of a cell stands once and whole, at the place of its column, above those of later rows and in the order of its cell."""
    rnd = random.Random(seed)
    height, wide = rnd.randint(1, 6), rnd.randint(1, 6)
    taken, cells, html = set(), [], "<table>"
    for r in range(height):
        html += "<tr>"
        for c in range(wide):
            if (r, c) in taken:
                continue
            across, down = rnd.choice([1, 1, 2, 3]), rnd.choice([1, 1, 2, 3])
            across = next(k for k in range(across, 0, -1) if c + k <= wide and not any((r, c + j) in taken for j in range(k)))
            down = min(down, height - r)
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
            lines = [f"r{r}c{c}n{k}" + rnd.choice(["", "x" * rnd.randint(0, 30), "y" * rnd.randint(50, 99)]) + "." for k in range(rnd.randint(1, 3))]
            cells.append((r, c, r + down, lines))
            html += f"<td colspan={across} rowspan={down}>" + rnd.choice(["<br>", "<div>"]).join(lines)
    out = html_text.html_to_text(html).split("\n")
    base = min(len(x) - len(x.lstrip(" ")) for x in out if x)
    assert base == 0
    where = {x: [(y, line.index(x)) for y, line in enumerate(out) if x in line] for _, _, _, lines in cells for x in lines}
    assert all(len(x) == 1 for x in where.values())
    assert sum(len(x) for line in out for x in line.split()) == sum(map(len, where))
    column, rows = {}, {}
    for r, c, _, lines in cells:
        column.setdefault(c, set()).update(where[x][0][1] for x in lines)
        ys = [where[x][0][0] for x in lines]
        assert ys == sorted(set(ys))
        rows[r, c] = ys
    assert all(len(x) == 1 for x in column.values())
    places = [x for _, (x,) in sorted(column.items())]
    assert places == sorted(set(places))
    for r, c, end, _ in cells:
        assert all(max(rows[r, c]) < min(rows[a, b]) for a, b, _, _ in cells if a >= end)


@pytest.mark.parametrize("seed", range(20))
def test_html_words_against_the_tree(seed):
    """The visible words of random trees in their order; the words are known when the tree is drawn."""
    rnd, shown, count = random.Random(seed), [], iter(range(10**6))

    def tree(depth, visible):
        if depth == 0 or rnd.random() < 0.3:
            word = f"w{next(count)}"
            if visible:
                shown.append(word)
            return f" {word} "
        inner = lambda seen=visible: "".join(tree(depth - 1, seen) for _ in range(rnd.randint(1, 4)))
        kind = rnd.choice(["div", "section", "b", "li", "pre", "hidden", "none", "script", "table"])
        if kind == "hidden":
            return f"<div hidden>{inner(False)}</div>"
        if kind == "none":
            return f"<span style='display: none'>{inner(False)}</span>"
        if kind == "script":
            return f"<script>w{next(count)}</script>"
        if kind == "li":
            return f"<ul><li>{inner()}</ul>"
        if kind == "table":
            return f"<table><tr><td>{inner()}<tr><td>{inner()}</table>"
        return f"<{kind}>{inner()}</{kind}>"

    html = "".join(tree(6, True) for _ in range(8))
    assert [x for x in html_text.html_to_text(html).split() if x != "-"] == shown


def test_html_is_deep_and_long():
    assert html_text.html_to_text("<div>" * 50_000 + "x") == "x"
    assert html_text.html_to_text("<table><tr><td>" * 20_000 + "x") == "x"
    assert html_text.html_to_text("word " * 200_000).count("word") == 200_000


def test_html_buttons_and_ruby():
    assert html_text.html_to_text('<p>a <input type=submit value="Go &amp; see"> b<input type=text value=no> <input type="RESET"><input type=button hidden value=x><input type=button></p>') == "a Go & see b Reset"
    assert html_text.html_to_text("<ruby>k<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>") == "kkan"


@pytest.mark.parametrize("html", ["<p><button>" + "<div>" * 100_000, "<p>" * 100_000, "<ul><li><b>" * 50_000 + "</b>" * 50_000, "<table><tr><td>" * 20_000 + "</p></b></div>" * 20_000])
def test_html_trees_take_linear_time(html):
    began = time.process_time()
    html_text.parse(html)
    assert time.process_time() - began < 15  # seconds; hours if every tag looked through the open elements


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old"), (1, "<p>a", "old"), (None, None, None)], "page_id long, html string, text string")
    same(html_text.extract_text(pages).select("page_id", "text").collect(), [(1, "a"), (1, "a"), (None, "")])
    assert html_text.extract_text(pages.where("false")).count() == 0


# --- 2: WARC ---


def test_chunks():
    body = bytes(range(256)) * 99
    assert warc.unchunked(warc.chunked(body, 1000)) == body and warc.unchunked(b"0\r\n\r\n") == b""
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_warc_round_trip(spark):
    big = "é" * 5000 + "\r\n0\r\n\r\n"
    rows = [(5, "http://a/ b\n", big), (3, None, big), (9, "u", big), (9, "u", big), (1, "x", "small"), (2, "x", "small"), (4, "e", ""), (6, "n", None), (None, "z", big), (None, "z", "q" * 200), (None, "z", "q" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write_archives(pages, segment=700)
    d = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    want = [(p, *d(h), "response", None) if not (h == big and p != 3) else (p, *d(h), "revisit", 3) for p, _, h in rows]
    same(warc.payload_table(spark, files).drop("error").collect(), want)
    read = warc.read_archives(spark, files).where("record_type = 'response'").collect()
    assert all(r.error is None for r in read) and {bytes(r.payload).decode() for r in read} == {"small", "", big, "q" * 200}
    assert warc.write_archives(pages.where("false")).count() == 0
    assert warc.payload_table(spark, warc.write_archives(pages.where("false"))).count() == 0


def test_warc_reports_broken_segments(spark, tmp_path):
    records = list(warc.page_records(1, "u", b"x" * 3000, None, "<id>", 1000))
    for name, kept in (("gap", records[:1] + records[2:]), ("cut", records[:-1]), ("whole", records[::-1])):
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(kept))
    got = {n: warc.read_archives(spark, spark.createDataFrame([(str(tmp_path / f"{n}.warc.gz"),)], "path string")).first() for n in ("gap", "cut", "whole")}
    assert got["gap"].error == "a segment is missing" and got["cut"].error == "another total length"
    assert got["whole"].error is None and bytes(got["whole"].payload) == b"x" * 3000


# --- 3 and 9: tokens ---


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE)


def test_chunks_encode_as_whole_texts(byte_tokenizer):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "b ", " ", "\n", "\t", "don't", "é", ",", ".\n", "x1", "\xa0", " ", "<|endoftext|>", "The", ") ", "\x1c"]) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    tool = ChunkEncoder(BYTE, remember=500)
    for k in range(0, len(texts), 300):
        flat, counts = tool.encode([None, *texts[k : k + 300]])
        at = np.cumsum(counts)
        assert counts[0] == 0
        for i, t in enumerate(texts[k : k + 300], 1):
            assert flat[at[i] - counts[i] : at[i]].tolist() == byte_tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store(spark, byte_tokenizer, encoding):
    rows = corpus()
    store = token_store.write_token_store(frame(spark, rows), BYTE, 2, encoding=encoding, group_ids=3000)
    got = store.read(spark).collect()
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]
    same([(r.doc_id, r.n_tokens, crc(r.tokens)) for r in got], [(i, len(x), crc(x)) for i, t in rows for x in [ids_of(byte_tokenizer, t)]])
    fs, path = work.locate(store.folder + "/files")
    groups = 0
    for f in fs.get_file_info(__import__("pyarrow.fs", fromlist=["x"]).FileSelector(path)):
        meta = pq.ParquetFile(f.path).metadata
        groups = max(groups, meta.num_row_groups)
        assert meta.row_group(0).column(0).has_offset_index
    assert groups > 1
    late = fs.get_file_info(__import__("pyarrow.fs", fromlist=["x"]).FileSelector(path))[0].path  # of an attempt that ends after all
    copy = pq.read_table(late)
    pq.write_table(copy.set_column(2, "attempt", [["late"] * copy.num_rows]), path + "/ids-late.parquet")
    assert store.read(spark).count() == len(rows)
    plan = store.read(spark, "doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    assert token_store.write_token_store(frame(spark, EMPTY), BYTE, 2).read(spark).count() == 0


def test_packing(spark, byte_tokenizer):
    rows = corpus()
    got = packing.pack_documents(frame(spark, rows), BYTE, 2, capacity=100, shard_size=40).collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(byte_tokenizer, t)
        n = -(-len(ids) // 100)
        first = len(ids) - 100 * (n - 1)
        for k in range(n):
            start = 0 if k == 0 else first + 100 * (k - 1)
            want[i, k, start, tuple(ids[start : first + 100 * k])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.tokens)) for r in got) == want
    sequences = {}
    for r in got:
        assert r.length == len(r.tokens)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= 100
    assert packing.pack_documents(frame(spark, EMPTY), BYTE, 2).count() == 0


@pytest.mark.parametrize("lengths", [[60] * 50, [51, 49] * 10 + [60] * 30])
def test_packing_places_pieces_of_bins_that_never_fill(spark, lengths):
    pieces = spark.createDataFrame(list(enumerate(lengths)), "piece_key long, length long")
    got = packing.pack_lengths(pieces, 100, shard_size=10).collect()
    same([(r.piece_key, r.length) for r in got], list(enumerate(lengths)))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and all(r.offset + r.length <= 100 for r in got)


def test_sum_of_squares_is_the_rule():
    rnd, capacity = random.Random(3), 30
    lengths = [rnd.randint(1, 30) for _ in range(300)]
    bins, offsets, gaps = packing.sum_of_squares(np.array(lengths), capacity)
    left = []
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        square = lambda x: sum(n * n for g, n in Counter(x).items() if g)
        cost = {g: square([*left[: left.index(g)], *left[left.index(g) + 1 :], g - s]) for g in {*left} if g >= s} or {capacity: 0}
        old = left[b] if b < len(left) else capacity
        assert cost[old] == min(cost.values()) and o == capacity - old
        if b < len(left):
            left[b] = old - s
        else:
            left.append(capacity - s)
    assert left == gaps.tolist()


def test_packing_replays_the_rule(spark):
    """On the operator's own rows, longest first: each went where the sum of squares became smallest."""
    rnd, capacity = random.Random(4), 50
    lengths = [rnd.randint(1, 49) for _ in range(200)]
    got = packing.pack_lengths(spark.createDataFrame(list(enumerate(lengths)), "piece_key long, length long"), capacity).collect()
    left = {}
    for r in sorted(got, key=lambda r: (-r.length, r.piece_key)):
        counts = Counter(g for g in left.values() if g)
        cost = {g: 2 * (counts[g - r.length] - counts[g] + 1) if g > r.length else 1 - 2 * counts[g] for g in counts if g >= r.length}
        old = left.get(r.sequence_id, capacity)
        assert r.offset == capacity - old
        if cost:
            assert r.sequence_id in left and cost[old] == min(cost.values())
        else:
            assert r.sequence_id not in left
        left[r.sequence_id] = old - r.length


# --- 4: embeddings ---


def test_forest_depth_and_recall():
    """Tables of a few hundred vectors are split; of pairs near the threshold most meet in trees of 12 levels."""
    assert [rp_forest.depth_of(n) for n in (1, 64, 127, 128, 256, 500, 2000, 16384, 65536, 1 << 25)] == [0, 0, 0, 1, 2, 2, 2, 2, 3, 12]
    rnd = np.random.Generator(np.random.PCG64(5))
    sample = rp_forest._unit(rnd.standard_normal((20000, 64)))
    a = rp_forest._unit(rnd.standard_normal((1000, 64)))
    other = rnd.standard_normal((1000, 64))
    other = rp_forest._unit(other - np.einsum("ij,ij->i", a, other)[:, None] * a)
    b = 0.952 * a + np.sqrt(1 - 0.952**2) * other
    met, copies = np.zeros(1000, dtype=bool), 0
    for t in range(rp_forest.TREES):
        tree = rp_forest.Tree(t, sample, 12, 0.95)
        (row, leaf), (there, at) = tree.route(a), tree.route(b)
        copies += len(row) / 1000
        pairs = {*zip(row.tolist(), leaf.tolist())} & {*zip(there.tolist(), at.tolist())}
        met[[r for r, _ in pairs]] = True
    assert met.mean() >= 0.97 and copies <= 20


def test_rp_forest(spark, monkeypatch):
    for name, value in (("LEAF", 30), ("BLOCK", 50), ("ROWS", 16)):
        monkeypatch.setattr(rp_forest, name, value)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 16))
    near = base[:60] + 0.1 * rng.standard_normal((60, 16))
    x = np.concatenate([base, near, 7 * base[:5], base[:9]]).astype(np.float32)
    rows = [(i, v.tolist(), -1) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None], 0), (904, [], 0), (None, x[0].tolist(), 0), (905, [float("inf")] * 16, 0), (906, [2.0, 1.0], 0), (907, [4.0, 2.0], 0), (3, x[3].tolist(), 0)]
    got = rp_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int"), 0.95).collect()
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            v, w = rows[i][1], rows[j][1]
            if v and w and len(v) == len(w) and None not in v + w:
                v, w = np.float64(v), np.float64(w)
                if np.isfinite(v).all() and np.isfinite(w).all() and v.any() and w.any() and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    smallest = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    want = [(i, links[k], smallest.get(find(k)), i is not None and i == smallest.get(find(k))) for k, (i, _, _) in enumerate(rows)]
    recall = sum(r.n_links for r in got) / sum(links)
    assert recall >= 0.9 and all(r.n_links <= max(n for i, n, *_ in want if i == r.vec_id) for r in got)
    if recall == 1:
        same(got, want)
    assert rp_forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 5: Jaccard join ---


def shingles(text, size):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])


def jaccard_truth(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [(i, len(sets[k]), smallest.get(find(k))) for k, (i, _) in enumerate(rows)], {find(k) for k in range(len(rows)) if sets[k]}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 30)])
def test_jaccard_join(spark, size, percent):
    rnd = random.Random(7)
    rows = corpus(2)
    origin = [f"w{k}" for k in range(80)]
    for k in range(40):  # a family of near copies, of which many link through others alone
        own = list(origin)
        for _ in range(rnd.randint(1, 4)):
            own[rnd.randrange(80)] = f"x{rnd.random()}"
        rows.append((1000 + k, " ".join(own)))
    want, classes = jaccard_truth(rows, size, percent)
    join = jaccard_join.jaccard_join(frame(spark, rows), size, percent)
    same(join.meta.select("doc_id", "n_shingles", "component_id").collect(), want)
    kept = join.representatives()
    bare = sum(not shingles(t, size) for _, t in rows)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(classes) + bare
    assert jaccard_join.jaccard_join(frame(spark, EMPTY)).meta.count() == 0


def test_representatives_of_null_and_repeated_ids(spark):
    """Texts that are not linked are apart, whatever their doc_ids; linked ones are one, whatever theirs."""
    texts = [" ".join(f"{x}{k}" for k in range(30)) for x in "abcde"]
    near = texts[0] + " more"
    rows = [(None, texts[0]), (None, texts[1]), (None, near), (7, texts[2]), (7, texts[3]), (7, texts[3]), (9, texts[4]), (None, texts[4]), (None, None), (7, "")]
    join = jaccard_join.jaccard_join(frame(spark, rows))
    same(join.meta.select("doc_id", "n_shingles", "component_id").collect(), jaccard_truth(rows, 4, 85)[0])
    kept = [(r.doc_id, r.text) for r in join.representatives().collect()]
    first = [x for x in kept if x in ((None, texts[0]), (None, near))]  # equal rank: either
    assert len(first) == 1
    same([x for x in kept if x not in first], [(None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (None, None), (7, "")])


def thue_morse(n=10):
    """Two words of 2**n letters that collide under every polynomial modulo 2**64 with an odd base."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [64, 9, 2])
def test_jaccard_join_under_colliding_hashes(spark, monkeypatch, bits):
    """Results don't depend on the hash: cut to few bits, it only makes more candidates."""
    of_lanes = words_module.Hasher.of_lanes
    monkeypatch.setattr(words_module.Hasher, "of_lanes", lambda self, *x: of_lanes(self, *x) >> np.uint64(64 - bits))
    monkeypatch.setattr(words_module.Hasher, "windows", lambda self, h, size: sum(h[k : len(h) - size + 1 + k] for k in range(size)) << np.uint64(50) if len(h) >= size else h[:0])
    one, other = thue_morse()
    rows = [(1, f"one two {one} four five six"), (2, f"one two {other} four five six"), *corpus(8, 15)]
    for block in (8192, 3):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        join = jaccard_join.jaccard_join(frame(spark, rows), 3, 50)
        same(join.meta.select("doc_id", "n_shingles", "component_id").collect(), jaccard_truth(rows, 3, 50)[0])


def test_suffix_filter():
    rnd = random.Random(3)
    for _ in range(500):
        x, y = (np.array(sorted(rnd.sample(range(40), rnd.randint(1, 30)))) for _ in range(2))
        assert jaccard_join.differing(x, y) <= len(set(x.tolist()) ^ set(y.tolist()))
        both, either = len({*x.tolist()} & {*y.tolist()}), len({*x.tolist()} | {*y.tolist()})
        assert jaccard_join.linked(x, y, 60) == (100 * both >= 60 * either)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_prefix_and_bounds(percent):
    for n in range(1, 200):
        p = int(jaccard_join.prefix_length(np.array([n]), percent)[0])
        assert 1 <= p <= n and 100 * (n - p) < percent * n
        for m in (n, n + 1, n + 17):
            need = int(jaccard_join.needed(np.array([n]), np.array([m]), percent)[0])
            assert 100 * need >= percent * (n + m - need) and 100 * (need - 1) < percent * (n + m - need + 1)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5), limit=50).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert len(forest(np.arange(0), np.arange(0))[0]) == 0


# --- 6: BPE ---


def test_bpe(spark):
    truth = Tokenizer.from_file(WORD)
    truth.no_truncation()
    truth.no_padding()
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["th", "ing", "a", "É", "'s", "'LL", " ", "9", "ΑΣ", "!?", "é", "<|endoftext|>", "日", "İ", "\x1f", "\n"]) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "a" * 20_000, "ab" * 5000, " \t"]
    rows = list(enumerate(texts))
    df = bpe_dp.decode_ids(bpe_dp.encode_texts(frame(spark, rows), WORD), WORD)
    assert "kept" in df.columns
    for r in df.collect():
        ids = truth.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.text == truth.decode(ids, skip_special_tokens=False)
    assert bpe_dp.encode_texts(frame(spark, EMPTY), WORD).count() == 0


# --- 7: CTW ---


def test_ctw(spark, monkeypatch):
    import math

    texts = ["The cat sat on the mat", "a dog; the cat", "", None, "éa the  the\nThe mat", "dog on mat zebra", "\x00\xff ok"] * 3
    rows = list(enumerate(texts)) + [(None, "cat mat")]
    got = ctw.score(frame(spark, rows), n_buckets=7).collect()
    depth = ctw.DEPTH
    held = [zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else True for i, _ in rows]

    def canonical(t):
        return b" ".join((t or "").encode().translate(LOWER).split()) + b"\n"

    counts = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            x = b"\n" * depth + canonical(t)
            counts.update((x[i - d : i], 1 << k | x[i] >> 8 - k, x[i] >> 7 - k & 1) for i in range(depth, len(x)) for d in range(depth + 1) for k in range(8))
    children = {}
    for c, p, _ in counts:
        if c:
            children.setdefault((c[1:], p), set()).add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, p, path, bit, memo={}):
        """With bit counted once more along the path; without: as trained."""
        if path is None and (c, p) in memo:
            return memo[c, p]
        more = path is not None and path.endswith(c)
        a, b = counts[c, p, 0] + (more and not bit), counts[c, p, 1] + (more and bit)
        out = kt(a, b)
        if len(c) < depth:
            below = children.get((c, p), set()) | ({path[len(path) - len(c) - 1 :]} if more else set())
            out = math.log(0.5) + np.logaddexp(out, sum(weighted(x, p, path if path and path.endswith(x) else None, bit) for x in below))
        if path is None:
            memo[c, p] = out
        return out

    def score(t):
        x = b"\n" * depth + canonical(t)
        return sum(weighted(b"", 1 << k | x[i] >> 8 - k, x[i - depth : i], x[i] >> 7 - k & 1) - weighted(b"", 1 << k | x[i] >> 8 - k, None, 0) for i in range(depth, len(x)) for k in range(8)) / math.log(10)

    tokens = [[*canonical(t).split(), b"\n"] for _, t in rows]
    unigram = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    total, distinct = sum(unigram.values()), len(unigram)
    want = [(i, h, len(x), sum(unigram[w] > 0 for w in x), total, sum(math.log10((unigram[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in x), float(score(t))) for (i, t), h, x in zip(rows, held, tokens)]
    same([tuple(r)[:7] for r in got], want)
    assert ctw.score(frame(spark, EMPTY)).count() == 0


def test_log_kt():
    import math

    a, b = np.array([0, 1, 5000, 4096, 100000]), np.array([0, 0, 3, 4097, 70000])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    assert np.allclose(ctw.log_kt(a, b), want, rtol=1e-12, atol=1e-9)


# --- 8: quality ---


def test_cascade(spark):
    rows = corpus(3) + [(2000 + k, t) for k, t in enumerate(["a b c " * 60, "x#y " * 60, "same line\n" * 40 + "other words " * 20, "1 2 3 4 " * 30, "ABC DEF " * 40, " ".join(f"good{k}" for k in range(80)), "a" * 5000])]
    got = cascade.judge(frame(spark, rows), measures=True)
    truth = []
    for i, t in rows:
        w, t = words(t), t or ""
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        truth.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base))
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), truth)
    plain = {(r.doc_id, r.text): r.kept for r in cascade.judge(frame(spark, rows)).collect()}
    shuffled = {(r.doc_id, r.text): r.kept for r in cascade.judge(frame(spark, rows), list(reversed(cascade.RULES))).collect()}
    assert plain == shuffled and plain == {(r.doc_id, r.text): r.kept for r in got.collect()}
    assert plain[2005, rows[-2][1]] and not any(plain[2000 + k, rows[len(rows) - 7 + k][1]] for k in (0, 1, 2, 3, 4, 6))
    assert cascade.judge(frame(spark, EMPTY)).count() == 0


def test_order_is_by_rejections_per_cost(spark):
    import time

    def slow(m):
        time.sleep(0)
        return sum(range(20_000)) > 0 and m.n_words < 100

    rules = [cascade.Rule("slow", slow), cascade.Rule("never", lambda m: False), cascade.Rule("cheap", lambda m: m.n_words < 60)]
    assert [r.name for r in cascade.order_rules(frame(spark, corpus(4)), rules)][0] == "cheap"


# --- 10: substrings ---


def removed(rows, size, seen=None):
    """Per row in order: words, removed, kept words."""
    seen, out = set() if seen is None else seen, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            if x in seen:
                gone[k : k + size] = [True] * size
            seen.add(x)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize(("size", "batches"), [(20, 1), (20, 4), (5, 3)])
def test_substring(spark, size, batches):
    rows = corpus(5)
    got = substring.dedup_substrings(frame(spark, rows), size, batches, n_buckets=5)
    assert set(got.columns) == set(SCHEMA.replace(",", "").split()[::2]) | {"n_removed"}
    same(got.select("doc_id", "n_words", "n_removed", "text").collect(), removed(rows, size))
    kept = substring.dedup_substrings(frame(spark, rows), size, batches, joined=False).where("n_removed = 0").select("doc_id", "text").collect()
    assert set(map(tuple, kept)) <= set(rows)
    assert substring.dedup_substrings(frame(spark, EMPTY)).count() == 0


def test_index_compacts_and_goes_on(spark):
    """Batches one after the other, with compaction, remove what one pass over all removes."""
    rows = corpus(6)
    index = substring.FingerprintIndex(spark, 4, 6, max_runs=2)
    seen = set()
    for k in range(5):
        batch = rows[k::5]
        got = index.add(frame(spark, batch)).cleaned()
        same(got.select("doc_id", "n_words", "n_removed", "text").collect(), removed(batch, 6, seen))
        assert len(index.runs) <= 2
    keys = np.concatenate([work.read_parquet(f"{run}/{b:07}")["key"].to_numpy() for run in index.runs for b in range(4)])
    assert len(keys) == len(seen)


@pytest.mark.parametrize("bits", [64, 8, 2])
def test_substring_under_colliding_hashes(spark, monkeypatch, bits):
    """Two windows of one fingerprint are told apart by their words, in one batch and over batches."""
    windows = words_module.Hasher.windows
    monkeypatch.setattr(words_module.Hasher, "windows", lambda self, h, size: windows(self, h, size) & np.uint64(2**64 - 2 ** (64 - bits) if bits < 64 else 2**64 - 1))
    one, other = thue_morse()
    head = " ".join(f"w{k}" for k in range(12))
    rows = [(-2, f"{head} {one} {head}"), (-1, f"{head} {other} {head}"), *corpus(9, 12)]
    for batches in (1, 3):
        got = substring.dedup_substrings(frame(spark, rows), 20, batches, n_buckets=3)
        same(got.select("doc_id", "n_words", "n_removed", "text").collect(), removed(rows, 20))
    got = {r.doc_id: r.n_removed for r in got.collect()}
    assert got[-1] == 0


def test_substring_orders_equal_ids_alike_in_all_parts(spark):
    w = " ".join(f"w{k}" for k in range(25))
    rows = [(5, w + " alpha"), (5, w + " beta"), (5, w + " gamma")]
    found = {tuple(sorted((r.text, r.n_removed) for r in substring.dedup_substrings(spark.createDataFrame(rows[k % 3 :] + rows[: k % 3], "doc_id long, text string").repartition(1 + k % 3)).collect())) for k in range(8)}
    assert len(found) == 1
