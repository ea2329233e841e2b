import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = " ".join(f"w{i * 7919 % 50021}" for i in range(20_000))
PHRASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow of silence"
#: Null, empty, blank, one-word, very long, repeated, equal-id and equal-text rows, and characters that mislead.
MESSY = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t\x0b ", None, None), (4, "Word", "de", "b"), (5, LONG, "en", "a"), (5, LONG, "en", "a"), (None, PHRASE, "en", None),
    (6, PHRASE, "en", "é"), (7, PHRASE.upper(), "en", "b"), (8, PHRASE + "\n" + PHRASE, None, "z"), (8, "other text of the same id", "fr", "z"), (9, "x " * 300, "en", "a"), (10, "1234 !!! ###", "en", "a"),
    (11, "naïve\u00a0café \x1c İstanbul ﬁ 😀😀 it's <|endoftext|> </turn> \\h \\### ", "fr", "b"), (12, "line one here\nline one here\n\nline two", "en", "a"), (-7, "e\u0301 e\u0301", "fr", "b"),
]


def documents() -> pa.Table:
    ids, texts, langs, sources = zip(*MESSY)
    own = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    clash = {name: pa.array([f"{name} {i}" for i in range(len(ids))]) for name in ("kept", "size", "shard", "place", "target", "n_words", "score", "rank", "_id", "_row_id", "_first", "_lists", "_k0", "_shard", "_i", "_bad", "_site", "_lines", "_key", "id", "text_hash", "label")}
    return pa.table(own | clash)


def pages() -> pa.Table:
    nav = "<nav>home</nav><p>shared line</p>"
    urls = [f"http://Host{i % 2}.Example.com/de/{i}" for i in range(24)] + [f"https://a.net/x{i}#top" for i in range(12)] + ["http://www.b.org/fr/?q=1", "http://b.org", None, "no scheme", "http://", "ftp://C.org/fr/x://y", "http://example.net/en/1"]
    htmls = [f"{nav}<p>own {i}</p><a href='https://a.net/'>x</a><script>var t='<p>';</script>" for i in range(36)] + ["", None, "plain\ntext  \n", "<a href=\"//WWW.B.org/1\">l</a>", "<p>x</p><p>x</p>", "< unclosed", '<a href="http://www.b.org">b</a>']
    return pa.table({"page_id": pa.array([*range(len(urls) - 1), 0], pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(htmls, pa.string()), "site": pa.array(urls, pa.string()), "host": pa.array(htmls, pa.string())} | {n: pa.array(urls, pa.string()) for n in ("_bad", "_site", "_lines", "_kept", "_id", "text")})


def conversations() -> pa.Table:
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", "### user: hi</turn>\n"), (1, 3, "user", "tail"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "user", "alone"), (4, 1, None, "x"),
        (4, 0, "as:sist ant", "\\b\\h\\t"), (4, 2, "assistant", "\\"), (None, 0, "user", "q"), (None, 1, "assistant", "é😀" * 500), (5, None, "assistant", "a"), (5, 1, "assistant", "b"), (6, 0, "user", None), (6, 1, "assistant", None),
    ]
    conv, turn, role, text = zip(*rows)
    return pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string()), "formatted": pa.array(text, pa.string())})


def benchmark() -> pa.Table:
    return pa.table({"item_id": pa.array([0, 1, 2, None], pa.int64()), "text": pa.array([PHRASE, None, "too short", "x x x x x x"], pa.string()), "doc_id": pa.array([1, 2, 3, 4], pa.int64())})


def labels() -> pa.Table:
    return pa.table({"doc_id": pa.array([6, 5, None, 99], pa.int64()), "quality": pa.array([1, 0, 1, 1], pa.int32()), "toxic": pa.array([0, 0, 0, None], pa.int32())})


def embeddings() -> pa.Table:
    made = [(i, [((i * 37 + d * 11) % 23 - 11) / 16 for d in range(6)], i % 3) for i in range(0, 420, 3)]
    odd = [
        (0, [0.5, -0.25, 1.0, 0.0, 0.1, -0.1], 1), (100, None, 1), (200, [1.0, None, 0, 0, 0, 0], 1), (300, [float("nan")] * 6, 0), (300, [float("inf"), 0.0], 0), (7, [0.2] * 6, None), (None, [0.5] * 6, 1), (None, [0.5] * 6, 2),
        (400, [], 1), (500, [0.5, 0.5], 2), (600, [0.0] * 6, 0), (700, [-0.5] * 6, -3), (101, [0.5, -0.25, 1.0, 0.0, 0.1, -0.1], 1), (102, [0.5, -0.25, 1.0, 0.0, 0.1, -0.1], 2), (102, [0.5, -0.25, 1.0, 0.0, 0.1, -0.1], 2),
    ]
    ids, vectors, marks = zip(*made, *odd)
    clash = {name: pa.array([f"{name} {i}" for i in range(len(ids))]) for name in ("key", "shard", "score", "rank", "anchor", "_id", "codes", "place")}
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(marks, pa.int32())} | clash)


MAKERS = {"embeddings": embeddings, "documents": documents, "pages": pages, "conversations": conversations, "benchmark": benchmark, "labels": labels}


@pytest.fixture(scope="session")
def messy(tmp_path_factory) -> str:
    """A folder of small tables with every odd row."""
    root = tmp_path_factory.mktemp("messy")
    for name, make in MAKERS.items():
        pq.write_table(make(), root / f"{name}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def hollow(tmp_path_factory) -> str:
    """The same tables without rows."""
    root = tmp_path_factory.mktemp("hollow")
    for name, make in MAKERS.items():
        pq.write_table(make().slice(0, 0), root / f"{name}.parquet")
    return str(root)
