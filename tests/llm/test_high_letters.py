import sys

from graphloom.llm.language_id import letter_codes


def test_letters_of_all_planes():
    assert len(letter_codes("\U00020000\U0002a6df \U000323af")) == 6
    assert len(letter_codes("\U0001ffff\U000e0001\U0010ffff")) == 0
    assert max(p for p in range(sys.maxunicode + 1) if chr(p).isalpha()) < 0x40000
