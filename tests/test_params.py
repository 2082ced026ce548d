import pytest

from methylspark.params import Params


def test_defaults():
    p = Params()
    assert (p.window, p.min_mapq, p.min_read_length, p.min_base_quality) == (1000, 20, 1000, 20)
    assert (p.methyl_high, p.methyl_low, p.min_site_coverage, p.min_common_coverage) == (
        0.8, 0.2, 5, 3)


@pytest.mark.parametrize("bad", [
    {"window": 0}, {"window": -100}, {"methyl_high": 0.3, "methyl_low": 0.5},
    {"methyl_high": 1.5}, {"methyl_low": -0.1}, {"methyl_high": 0.2, "methyl_low": 0.2},
    {"metric": "cosine"}, {"missing_pairs": "zero"}, {"min_mapq": -1}])
def test_invalid(bad):
    with pytest.raises(ValueError):
        Params(**bad)
