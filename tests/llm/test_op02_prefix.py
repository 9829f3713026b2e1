import pyarrow as pa
import pytest

from lumenact.llm import chat_format


def test_wrong_context_is_noticed():
    turns = pa.RecordBatch.from_pydict(
        {"conv_id": [1] * 4, "role": ["user", "assistant"] * 2, "text": ["one", "two", "three", "four"]})
    examples = pa.Table.from_batches(chat_format._examples(iter([turns])))
    assert next(chat_format._digests(iter(examples.to_batches())))["n_turns"].to_pylist() == [4]
    texts = examples["formatted"].to_pylist()
    texts[1] = texts[1].replace("one", "eno", 1)
    at = examples.schema.get_field_index("formatted")
    wrong = examples.set_column(at, "formatted", pa.array(texts))
    with pytest.raises(ValueError, match="does not repeat"):
        list(chat_format._digests(iter(wrong.to_batches())))
