import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASHES = ("words", "lines", "h1", "h2", "fp", "label", "row", "n", "bin", "media", "part", "key", "_doc", "kept", "fence", "score", "length", "start", "doc")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)


def edge_texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(14), line(12), line(3)]
    texts = [None, "", " ", "\n\n", "x", "1 2 3", "日本   x", "a\tb\x0bc\r\nd", "\n".join(shared), "\n".join([line(5), *shared, line(4)]), "\n".join([*shared, "", line(30)])]
    texts += [line(60), line(60), "!!! $$$ ### " * 20, "ab " * 300, line(4000)]
    near = line(200).split(" ")
    for k in range(6):
        near[k * 20] = word()
        texts.append(" ".join(near))
    texts += [texts[11]] * 4 + ["\n".join(shared)] * 3 + [line(r.randint(1, 40)) for _ in range(30)]
    return texts


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "s0", "s1"][k % 2], k, *CLASHES) for k, t in enumerate(edge_texts())]
    return [*rows, rows[9], (None, "lost words here", None, None, None, *[None] * len(CLASHES))]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """Nulls in every column, empty and long texts, ties, a repeated row, and clashing columns."""
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
