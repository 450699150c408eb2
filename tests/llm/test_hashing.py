import pyarrow as pa
import pytest

from stillgood.llm import common


@pytest.mark.parametrize("together, piece", [(300_000, 4_000_000), (20, 4_000_000), (1, 1), (50, 30)])
def test_words_hash_alike_wherever_they_stand(monkeypatch, together, piece):
    """Equal words give equal numbers, others do not, whatever is hashed together or cut in pieces."""
    monkeypatch.setattr(common, "TOGETHER", together)
    monkeypatch.setattr(common, "PIECE", piece)
    texts = [None, "", "  ", "one Two  three", "TWO\tone\x0bthree \n", "é É 中文\U0001f600 a", "x" * 70 + " y " * 40, "\xa0one one"]
    names = {}
    rows = list(common.hashed_words(pa.array(texts, pa.string())))
    assert len(rows) == len(texts)
    for text, h in zip(texts, rows):
        found = common.words(text)
        assert len(found) == len(h)
        for word, number in zip(found, h.tolist()):
            assert names.setdefault(word, number) == number
    assert len(set(names.values())) == len(names)
    assert list(common.hashed_words(pa.array([], pa.string()))) == []
