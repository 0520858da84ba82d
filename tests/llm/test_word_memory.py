import public_tokenizers
import pyarrow as pa

from cairnlake.llm.tokens import ALONE, MOST_PARTS, MOST_WORDS, WordIds


def test_packing_alone_keeps_more_words_and_the_same_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    few, many = WordIds(path), WordIds(path, ALONE)
    assert (few.most_words, few.most_parts) == (MOST_WORDS, MOST_PARTS) and many.most_words >= 1_000_000 and many.most_parts >= 600_000
    few.most_words = few.most_parts = 50
    for k in range(5):
        texts = pa.array([f"word{i} Some-thing {i * k} été{i}" for i in range(40)] + [""])
        assert few.of_texts(texts) == many.of_texts(texts)
    assert len(few.words) < len(many.words)
