import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def papers(spark):
    rows = [
        ("s::P18-1001", "P18-1001", "s", "Paper A", "We use BERT for question answering.", None, 2018, "acl", None, "https://x/a.pdf"),
        ("s::D19-1234", "D19-1234", "s", "Paper B", "LoRA tuning.", "Full text of B", 2019, "emnlp", None, None),
        ("t::2022.acl-long.100", "2022.acl-long.100", "t", "Paper C", "Multilingual models.", None, 2022, "acl", "long", None),
        ("t::2022.acl-long.101", "2022.acl-long.101", "t", "Paper D", "Nothing known here.", None, None, None, None, None),
    ]
    return spark.createDataFrame(
        rows,
        "id string, source_id string, source string, title string, abstract string, full_text string, "
        "year int, venue string, volume string, url string",
    )


@pytest.fixture(scope="session")
def authors(spark):
    rows = [
        ("s::P18-1001", "Ann Lee", 1),
        ("s::P18-1001", "Zed Ott", 0),
        ("s::D19-1234", "Ann Lee", 0),
        ("t::2022.acl-long.100", "Ann Lee", 0),
        ("t::2022.acl-long.100", "Zed Ott", 1),
    ]
    return spark.createDataFrame(rows, "paper_id string, name string, position int")


@pytest.fixture(scope="session")
def entities(spark):
    p1, p2, p3 = "s::P18-1001", "s::D19-1234", "t::2022.acl-long.100"
    rows = [
        (p1, "method", "BERT", "model"),
        (p1, "method", "Transformer", None),
        (p2, "method", "BERT", None),
        (p2, "method", "LoRA", "technique"),
        (p3, "method", "contrastive learning", None),
        (p1, "dataset", "SQuAD", "QA"),
        (p2, "dataset", "GLUE", None),
        (p2, "dataset", "SQuAD", None),
        (p1, "task", "machine translation", None),
        (p2, "task", "text classification", None),
        (p3, "task", "text classification", None),
        (p1, "topic", "multimodal", None),
        (p2, "topic", "efficiency", None),
        (p3, "topic", "multimodal", None),
    ]
    return spark.createDataFrame(rows, "paper_id string, entity_type string, name string, attr string")


@pytest.fixture(scope="session")
def chunks(spark):
    rows = [
        (1, "s::P18-1001", "We propose a novel transformer architecture for translation.", "abstract", 0, 10),
        (2, "s::D19-1234", "Contrastive learning improves sentence embeddings.", "abstract", 0, 7),
        (3, "s::D19-1234", "Experiments on sentence similarity show gains.", "full_text", 1, 7),
        (4, "t::2022.acl-long.100", "Question answering with retrieval and reading.", "abstract", 0, 7),
    ]
    return spark.createDataFrame(
        rows, "id bigint, paper_id string, chunk_text string, chunk_type string, chunk_index int, token_count int"
    )


@pytest.fixture(scope="session")
def embeddings(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], "s::P18-1001", 2018, "acl"),
        (2, [0.0, 1.0, 0.0], "s::D19-1234", 2019, "emnlp"),
        (3, [0.0, 0.9, 0.1], "s::D19-1234", 2019, "emnlp"),
        (4, [0.0, 0.0, 1.0], "t::2022.acl-long.100", 2022, "acl"),
    ]
    return spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, paper_id string, year int, venue string")
