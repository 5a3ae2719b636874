import pytest

from docquarry.operators.generation import ExtractiveClient, FallbackClient, generate


class Down:
    name = "down"

    def __init__(self, error):
        self.error = error

    def complete(self, messages):
        raise self.error


def test_fallback_only_where_unavailable():
    ask = [{"role": "user", "content": "[1] t\nIt is so. More."}]
    client = FallbackClient(Down(TimeoutError()), ExtractiveClient())
    assert client.complete(ask)[0] == "It is so. [1]" and client.name == "down"
    with pytest.raises(ValueError):
        FallbackClient(Down(ValueError()), ExtractiveClient()).complete(ask)
    with pytest.raises(ConnectionError):
        FallbackClient(Down(TimeoutError()), Down(ConnectionError())).complete(ask)


def test_generate_rows(spark):
    df = spark.createDataFrame([(1, "[1] a\nOne. Two.\n\n[2] b\nThree!", "q"), (2, None, None)], "query_id long, context string, question string")
    got = {r.query_id: r for r in generate(df, "be brief").collect()}
    assert got[1].raw_answer == "One. [1] Three! [2]" and got[1].completion_tokens == 4 and got[1].error is None
    assert got[2].raw_answer.startswith("The sources do not")
    assert generate(df.limit(0), "s").count() == 0
