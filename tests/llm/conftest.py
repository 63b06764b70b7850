import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside for columns of their own.
CLASHING = (
    "digest maybe copies rows h w lines fingerprint component_id n text_key score kept size target post at of "
    "root node chunks spans tail word gram position offset turned passes"
).split()


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows, clashing=False):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        schema = COLUMNS
        if clashing:
            full = [(*r, *("x" for _ in CLASHING)) for r in full]
            schema += "".join(f", {c} string" for c in CLASHING)
        return spark.createDataFrame(full, schema)

    return build


LONG = " ".join(f"word{i % 997} is {i}" for i in range(20_000))
#: Nulls, empty and blank texts, one very long text, ties, repeated rows.
EDGES = [
    (1, None, None),
    (2, "", "a"),
    (3, " \n\t ", "a"),
    (4, LONG, "b"),
    (5, "Same text here", "a"),
    (6, "same TEXT here", "a"),
    (6, "same TEXT here", "a"),
    (7, "Ünïcödé text — naïve café", None),
    (None, "no id", "a"),
    (None, "no id", "a"),
    (8, "x", "c"),
]


@pytest.fixture
def edges(documents):
    return documents(EDGES, clashing=True)


@pytest.fixture
def empty(documents):
    return documents([])


#: Texts of one long run: blanks, one letter, line ends, hex digits and keys in turn.
HUGE = [
    (1, " " * 2_000_000, "a"),
    (2, "x" * 2_000_000, "a"),
    (3, "\n" * 2_000_000, None),
    (4, "word" + " " * 1_000_000 + "word", "b"),
    (5, ("0123456789abcdef0123456789 Zq8Yt5Rw2Xp9Lk4Jh7Gf " * 20_000), "b"),
]


@pytest.fixture
def huge(documents):
    return documents(HUGE)
