import random

import pytest

EXTRA = "digest keep_id group_size salt ids decoded hit_spans hit_items n_words score lang_pred accepted fingerprint runs n_lines line kept removed n_bytes i h1 gram rank kind block range value pattern toxic term __id __key __k1 __k2 __runs __lines __bytes __in0 __in3 prefix"


def texts() -> list[str | None]:
    """Copies, near copies, repeated lines and passages, odd characters, empty, null and long texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    passage = prose(60)
    changed = base.split()
    changed[60] = "changed"
    lines = "\n".join(["shared line one", "shared line two", "", "shared line three"])
    return [
        None, "", " ", "\n\n", "a", "A b", base, base, base.upper(), " ".join(changed), base + " tail",
        f"{prose(30)}\n{lines}\n{prose(20)}", f"{lines}\n{lines}\n{prose(5)}", f"{prose(10)} {passage} {prose(40)}", f"{passage} {prose(9)}",
        "x" * 3000, "ab" * 900, "é" * 450, "🙂日本語 <|endoftext|> don't  stop\t\x1c\x85 ²½", "word " * 2500, prose(9000),
        "mail a.b@c.de x@y and 1.2.3.4 or 1.2.3.999 card 4111 1111 1111 1111 tel +1 (555) 123-4567 +12", "1.2.3.4.5.6.7.8 a@b.c%d@e.f 4111111111111111-4111",
        *(prose(rng.randint(1, 90)) for _ in range(40)),
    ]


def rows() -> list[tuple]:
    every = [(i * 3, t) for i, t in enumerate(texts())]
    every += [every[7], every[12], (None, "no id at all"), (None, None), (None, texts()[6]), (1000, texts()[13])]  # repeated rows, null ids
    return every


@pytest.fixture(scope="session")
def plain():
    return rows()


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with columns of clashing names, over several partitions."""
    df = spark.createDataFrame([(i, t, "en", "src", None) for i, t in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'{name}!' AS {name}" for name in EXTRA.split())).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
