import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use inside must not clash.
    "n long, key long, node long, head long, score double, copies int, row long, size long, sig string, token string"
)
EXTRA = (1, 2, 3, 4, 0.5, 6, 7, 8, "s", "t")


def sentence(rng, words, alphabet="abcdefgh"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 6))) for _ in range(words))


def make_texts():
    """Originals, exact and near copies, shared passages, very short and very long texts."""
    rng = random.Random(5)
    passage = sentence(rng, 30)
    texts = [None, "", "   \n\t", "one", "One", "two words", "a b c d", "A b C d", "x y z w v", "é ü"]
    for k in range(40):
        base = sentence(rng, rng.randint(6, 120))
        texts.append(base)
        if k % 3 == 0:
            texts += [base, base.upper()]
        if k % 4 == 0:
            words = base.split()
            for at in rng.sample(range(len(words)), max(1, len(words) // 25)):
                words[at] = "changed"
            texts.append(" ".join(words))
        if k % 5 == 0:
            texts.append(f"{passage} {sentence(rng, 8)}")
        if k % 7 == 0:
            texts.append(base + "\n" + base + "\n" + "%%% ### " * 20)
    family = sentence(rng, 60).split()
    for at in range(25):  # a group of near copies, each unlike in one word
        texts.append(" ".join([*family[: 2 * at], "other", *family[2 * at + 1 :]]))
    texts.append(sentence(rng, 60_000))
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(7 * k + 3, t, None, None if k % 9 == 0 else f"s{k % 4}", None, *EXTRA) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and repeated rows."""
    rows = [(None, "a b c d e f", "en", "s", 1, *EXTRA), (1, "a b c d e f", "en", "s", 1, *EXTRA)] + [(2, "q w e r t y", None, None, 1, *EXTRA)] * 3
    return spark.createDataFrame([*rows, (None, None, None, None, None, *EXTRA)], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
