"""What the driver holds while the toxicity network is fitted."""

from tarnwork.llm import toxicity


def test_hashed_rows_take_two_bytes_each():
    texts = [f"word{i} other{i * 7} and the same words in all of them".encode() * 3 for i in range(200)]
    words = toxicity.Words(texts)
    assert sum(g.nbytes for g in words.grams) <= 2 * len(words.grams) * (sum(map(len, texts)) + 2 * len(texts))
    assert words.word.nbytes == 2 * len(words.word)
    assert toxicity.WORD_ROWS - 1 <= toxicity.np.iinfo(words.word.dtype).max and toxicity.CHAR_ROWS - 1 <= toxicity.np.iinfo(words.grams[0].dtype).max
