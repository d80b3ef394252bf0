import random

import pytest

#: Columns whose names clash with what operators add or use inside.
CLASHES = "doc_id long, text string, lang string, source string, N_Words string, simhash string, spans string, licenses string, score string, lang_pred string, _id string"


def make_texts(seed: int = 5) -> list[str | None]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    shared, long = prose(120), prose(6000)
    near = prose(90)
    out = [None, "", " \n\t\x0b ", "a", "one two", "!!! ***", "x" * 5000, "aaaa " * 900, "ab" * 700, long, long[:9000] + " tail", shared, shared, shared + " more", prose(50) + " " + shared + " " + prose(50)]
    out += [prose(40) + " " + shared[:450] + " " + prose(30), near, near + " zz", near.replace(",", "", 1), near.upper(), "It's <|endoftext|> 12a3 ÀÉ÷ naïve — ≠ ß", "  x\u0085y"]
    out += [prose(r.randint(1, 200)) for _ in range(40)]
    return out + out[20:24]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Texts with clashing extra columns, over several partitions; the first row is there twice."""
    rows = [(k, t, ("en", "fr", None)[k % 3], f"s{k % 2}", "x", "x", "x", "x", "x", "x", "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHES).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < 0")
