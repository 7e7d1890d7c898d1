"""Words whose lower case ends in a combining mark, before punctuation."""

import numpy as np

from evidencelake.llm import tokens


def test_tokens_of_capitals_with_marks_equal_the_tokenizer():
    made = tokens.words()
    odd = ["DENİZLİ.", "İ, İ! DENİZ. İZMİR: Lİ"]
    assert [np.frombuffer(b, "<u4").tolist() for b in made.ids(odd)] == [[*made.tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in odd]
