import pyarrow as pa
import pytest
from test_orc_tokens import ENCODER, LIBRARY


@pytest.mark.parametrize("word", ["J̌amal", "xJ̌a", "H̱asan", "T̈a", "W̊ord", "ΣΑΣ", "İx", "Été", "Ångström", "KKelvin"])
@pytest.mark.parametrize("form", ["{}", "a {} b", "{}.", "x{}y, {}1!"])
def test_decomposed_capitals_equal_the_library(word, form):
    text = form.replace("{}", word)
    assert ENCODER.block(pa.array([text], pa.string()), 2).to_pylist() == [[*LIBRARY.encode(text, add_special_tokens=False).ids, 2]]
