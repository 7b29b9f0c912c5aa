import html as entities
import json
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlspring.llm.common import shared_dir
from marlspring.llm.hilbert import document_shards, hilbert_index
from marlspring.llm.html import Group, blocks, host_wrappers, html_text, main_text, page_wrapper
from marlspring.llm.token_files import read_token_files, token_crc, write_token_files
from marlspring.llm.warc import candidates, read_payloads, read_warc, reachable, write_warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_token_files_round_trip(spark, clashing, odd_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    path = shared_dir(spark)
    write_token_files(clashing, path, PATH, 2)
    rows = {r.doc_id: r for r in token_crc(read_token_files(spark, path)).collect()}
    start = 0
    for k, text in enumerate(odd_texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    one = read_token_files(spark, path).where("doc_id = 9").first()
    assert one.ids == [*t.encode(odd_texts[9], add_special_tokens=False).ids, 2]


def test_token_files_of_an_empty_table(spark, empty):
    path = shared_dir(spark)
    write_token_files(empty, path, PATH, 2)
    assert token_crc(read_token_files(spark, path)).count() == 0


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        index = hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(documents, odd_texts, empty):
    rows = document_shards(documents, 7).collect()
    assert len(rows) == len(odd_texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (odd_texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.grown_shard, r.law) == (len(raw) + 8, zlib.crc32(raw), None, "rows")
    assert document_shards(empty).count() == 0


PAGE = '<html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First  \n part<br><p>Second&nbsp;x &lt;b&gt;</p>{}</article><div class="comments"><p>Nice</p></div><footer>&copy; f</footer></body></html>'


@pytest.fixture
def pages(spark):
    big = "é" * 700
    fake = "x" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:marlspring:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a.x/1", big), (2, "http://a.x/2", big), (5, None, big), (3, "http://a.x/3", "small"), (4, "http://a.x/4\r\nX: y", "small"), (6, "http://b.x", None), (7, "http://b.x", ""), (8, "http://b.x", fake), (9, "http://b.x", fake), (10, "u", "WARC/1.1\r\n" * 300)]
    rows += [(k, f"http://c.x/{k}", PAGE.format(f"<p>number {k}</p>" * (k % 5))) for k in range(20, 60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("off", F.lit("clash")).repartition(3)


def test_warc_round_trip(spark, pages):
    path = shared_dir(spark)
    write_warc(pages, path, 4000)
    rows = {r.page_id: r for r in read_warc(spark, path).collect()}
    html = {r.page_id: r.html or "" for r in pages.collect()}
    assert rows.keys() == html.keys()
    import hashlib

    for k, h in html.items():
        raw = h.encode()
        top = max(j for j, g in html.items() if g == h)
        revisit = len(raw) >= 1000 and k < top
        assert (rows[k].payload_bytes, rows[k].payload_digest, rows[k].record_type, rows[k].refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None), k
        assert rows[k].intact
    payloads = {r.page_id: r.payload for r in read_payloads(spark, path, read_warc(spark, path)).collect()}
    assert payloads == {k: h for k, h in html.items() if rows[k].record_type == "response"}


@pytest.mark.parametrize("block", [200, 5000, 1 << 20])
def test_magic_inside_a_payload_is_no_record(spark, pages, block):
    path = shared_dir(spark)
    write_warc(pages, path, 1 << 20)
    found = candidates(spark, path, block)
    assert 77 in {r.page_id for r in found.collect()}
    ids = sorted(r.page_id for r in reachable(found).collect())
    assert ids == sorted(r.page_id for r in pages.collect())


def test_header_as_long_as_its_url(spark, pages):
    long = spark.createDataFrame([(70, "data:text/html," + "x" * 100_000, "<p>long</p>"), (71, " " * 50_000 + "WARC/1.1", "after")], "page_id long, url string, html string")
    path, all_ = shared_dir(spark), pages.select("page_id", "url", "html").union(long)
    write_warc(all_.coalesce(1), path, 1 << 20)
    rows = {r.page_id: r for r in read_warc(spark, path).collect()}
    assert rows.keys() == {r.page_id for r in all_.collect()} and rows[70].url == "data:text/html," + "x" * 100_000
    assert all(r.intact for r in rows.values())


def test_archives_end_before_they_grow_too_long(spark):
    """A run of long pages beside many short ones makes archives of the target's size, and a page over it one of its own."""
    rows = [(k, "u", f"{k:06d}" + "s" * 50) for k in range(3000)] + [(k, "u", f"{k:06d}" + "é" * 20_000) for k in range(3000, 3040)] + [(9000, "u", "x" * 300_000)]
    pages, path = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), shared_dir(spark)
    write_warc(pages, path, 100_000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert sum(n > 100_000 for n in sizes) == 1 and max(sizes) < 301_000 and sum(n < 50_000 for n in sizes) <= 2
    found = read_warc(spark, path)
    assert {r.page_id for r in found.collect()} == {k for k, _, _ in rows} and found.where("not intact").count() == 0
    assert {r.page_id: r.payload for r in read_payloads(spark, path, found).collect()} == {k: h for k, _, h in rows}


def test_broken_chain_is_an_error(spark, tmp_path):
    from marlspring.llm.warc import END

    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:marlspring:page:1>\r\nContent-Length: 5\r\n\r\nhello" + END
    for name, content in (("tail", record + b"WARC/1.1\r\nContent-Length: 9\r\n\r\nhello" + END), ("start", b"x" + record), ("none", b"nothing")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(content)
        with pytest.raises(Exception, match="record"):
            read_warc(spark, str(tmp_path / name)).collect()


def test_warc_of_no_pages(spark, pages):
    path = shared_dir(spark)
    write_warc(pages.limit(0), path)
    assert read_warc(spark, path).count() == 0


def test_main_text(pages):
    rows = {r.page_id: r for r in html_text(pages).collect()}
    for k in range(20, 60):
        want = "\n\n".join(["Head & line", "First part", "Second x <b>", *[f"number {k}"] * (k % 5)])
        assert (rows[k].text, rows[k].n_chars) == (want, len(want))
    assert rows[6].text == "" == rows[7].text and rows[3].text == "small"
    assert html_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<main><h1>A</h1><aside>no</aside><form>no<p>no</p></form><p>yes</main>", "A\n\nyes"),
        ("<body><header>no</header><p>yes <a href=x>link</a> more</p><div id='cookie-notice'>no</div><ul><li><a href=1>menu</a></li></ul></body>", "yes link more"),
        ("<article><header><p>by line</p><h1>Title</h1></header><p>x</p><article class='comment'><p>no</p></article></article>", "Title\n\nx"),
        ("<article><p>a<!-- <p>no</p> -->b</p><script>x = '<p>no</p>'</script><textarea>no</textarea><p>1 < 2 &am &#233;</p>", "ab\n\n1 < 2 &am é"),
        ("<article><table><tr><td>c1<td>c2<tr><td>c3</table><ol><li>i<li>j</ol></article>", "c1\n\nc2\n\nc3\n\ni\n\nj"),
        ("", ""),
        (None, ""),
        ("plain", "plain"),
    ],
)
def test_pages_without_a_wrapper(html, text):
    assert main_text(html, None) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="overflow-hidden"><article><p>x</p></article></div>', "x"),
        ('<div aria-hidden="false"><article><p>x</p></article></div>', "x"),
        ('<div class="header-fixed"><p>top</p><article><p>x</p></article></div>', "x"),
        ('<div id="has-cookie-banner"><main><p>x</p></main></div>', "x"),
        ('<div class="sidebar"><div class="no-comments"><article><p>x</p></article></div></div>', "x"),
        ('<div hidden><p>no</p></div><p hidden="">no</p><p data-x="hidden" class="hidden-no">yes</p>', "yes"),
        ('<article><section id="related-work"><h2 id="search-results">h</h2><p id="alert-1">p</p></section><div class="overflow-hidden">d</div></article>', "h\n\np\n\nd"),
        ('<article><div class="section" id="search"><p>s</p></div><div id="comments"><p>no</p></div><div class="Share x">no</div></article>', "s"),
        ('<main><p>x</p></main><div class="related"><article><p>other</p></article></div>', "x"),
        ('<article id="how-to-share-comments" class="post related-posts"><p>x</p></article>', "x"),
        ('<article><p>Body</p><div class="user-comments"><p>c</p></div><div class="cookie-bar">k</div><div class="ad-slot">a</div></article>', "Body"),
        ('<article><p>Body</p><section class="comment-list"><p>c</p></section><div id="comments-section"><p>c</p></div></article>', "Body"),
        ('<p>Body</p><div class="post-comments"><p>c</p></div><div class="cookie-notice">k</div><div class="share-buttons">s</div>', "Body"),
        ('<article><div class="related-work"><p>w</p></div><div class="ad-hoc">h</div><div class="social-science">s</div><div class="no-ads">n</div></article>', "w\n\nh\n\ns\n\nn"),
        ('<div class="content-sidebar-wrap"><article><p>x</p></article></div>', "x"),
    ],
)
def test_marks_are_whole_tokens_and_frames_keep_their_article(html, text):
    assert main_text(html, None) == text


def test_wrapper_has_optional_and_repeated_groups(spark):
    rows = [("h", PAGE.format("<p>x</p>" * k) + ("<div>tail</div>" if k % 2 else "")) for k in range(4)]
    (r,) = host_wrappers(spark.createDataFrame(rows, "host string, html string").repartition(3)).collect()
    w = json.loads(r.wrapper)
    assert "(<p>#</>)+" in w["expression"] and "?" in w["expression"] and w["roles"]["article/p"] == "main"
    assert blocks(entities.escape("<p>"))[0][1] == "<p>"


def test_the_wrapper_decides_where_nothing_names_the_article(spark):
    """Unmarked notices, menus and footers of a host are known by its other pages; articles, and copies of one, stay."""
    rows, want = [], {}
    for k in range(40):
        body = [f"Title {k % 33}", *[f"Paragraph {j} of page {k % 33} with words of its own" for j in range(1 + k % 33 % 4)]]
        menu = '<a href="/">Home</a> <a href="/x">Long list of things</a>' + ("" if k % 4 else " new today, and for a longer while")
        page = f"<div><p>We use small files to know you.</p></div><div class=top><p>{menu}</p></div><div class=body><h2>{body[0]}</h2>" + "".join(f"<p>{b}</p>" for b in body[1:]) + "</div><div class=end>All rights with us</div>"
        rows.append((k, f"http://plain.example/{k}", page))
        want[k] = "\n\n".join(body)
    rows.append((99, "http://other.example/", rows[0][2]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).repartition(5)
    found = {r.page_id: r.text for r in html_text(df.union(df.where("page_id = 3"))).collect()}
    alone = {k: main_text(h, None) for k, _, h in rows}
    assert {k: found[k] for k in want} == want
    assert sum(found[k] != alone[k] for k in want) == 40
    assert found[99] == alone[99]  # a host of one page has no template text


def test_groups_of_one_path_are_told_apart_by_the_wrapper(spark):
    """A list of links is a menu by its place in the wrapper, though an article's texts have the same path; groups were judged by paths alone."""
    rows, want = [], {}
    for k in range(12):
        links = "".join(f'<p><a href="/{k}/{j}">Story {k} {j} on things</a></p>' for j in range(6))
        body = [f"Paragraph {j} of page {k}, with so many words of its own that it outweighs any list of links beside it" for j in range(1 + k % 3)]
        tail = f"<h2>More {k}</h2>" if k % 4 == 0 else ""
        rows.append((k, f"http://lists.example/{k}", f"<div>{links}</div><h2>Title {k}</h2><div>" + "".join(f"<p>{b}</p>" for b in body) + f"</div>{tail}"))
        want[k] = "\n\n".join([f"Title {k}", *body, *([f"More {k}"] if tail else [])])
    rows.append((50, "http://lists.example/50", "<h2>Title 50</h2><div><p>A page without its list</p></div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r.text for r in html_text(df).collect()}
    assert found == want | {50: "Title 50\n\nA page without its list"}
    (r,) = host_wrappers(df.selectExpr("'h' AS host", "html")).collect()
    expression = json.loads(r.wrapper)["expression"]
    assert "".join(g.expression() for g in Group.read(expression).groups) == expression and "<div>-" in expression


def test_deep_and_broken_pages_take_linear_time():
    began = time.perf_counter()
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000, None) == "deep"
    assert len(main_text("<div>x" * 150_000, None)) == 150_000 * 3 - 2
    assert main_text("<a " * 350_000, None).startswith("<a <a")
    for broken in ('<a x=">" ' * 100_000, "<a x='" * 150_000, "<head>" * 150_000, "</p>" * 250_000, "<div>" * 100_000 + "</x>" * 100_000, "<ul>" + "<div>" * 100_000 + "<li></li>" * 50_000, "<!-- " * 200_000, "<h2>a<p>b" * 60_000):
        main_text(broken, None)
        page_wrapper(blocks(broken))
    assert time.perf_counter() - began < 60
    assert main_text("<article>" + "<div>" * 300 + "<nav>no</nav><p>yes", None) == "yes"


def test_columns_of_words_are_encoded_as_whole_texts():
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from marlspring.llm.token_files import LibraryEncoder

    texts = ["cut off", "plain words, plain words", None, "", " lead and trail ", "two  spaces", "a \n b", "x<|endoftext|>y z", "é ü日 1 a's", "plain", " ", "cut off"]
    column, end = pa.array(texts, pa.string()).slice(1, 10), np.array([7], "<u4").tobytes()
    library = Tokenizer.from_file(PATH)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts[1:11]]
    n, ids = LibraryEncoder(PATH).encode_column(column, end)
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    for few in (column.slice(0, 0), column.slice(1, 2)):
        n, ids = LibraryEncoder(PATH).encode_column(few)
        assert n.tolist() == [0] * len(few) and not len(ids)
