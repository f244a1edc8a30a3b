import pytest

from webloom.plans.config import ConfigError, CrawlConfig, apply_rc, load_rc, parse_args


def test_rc_lines():
    c = load_rc(CrawlConfig(), ["# c\n\nNo_Clobber = on\nrec-level = inf\nquota = 2k\ntimeout=3m\nrobots = off\n"])
    assert c.no_clobber and c.level == -1 and c.quota == 2048 and c.read_timeout == 180.0
    assert apply_rc(CrawlConfig(), "reclevel = 0").level == 0
    assert apply_rc(CrawlConfig(), "mirror = on").recursive
    for bad in ("nothing", "unheard = 1", "quiet = maybe", "mirror = off", "quota = x"):
        with pytest.raises(ConfigError):
            apply_rc(CrawlConfig(), bad)


def test_args():
    c = parse_args(["-r", "-l", "0", "-A", "*.a,*.b", "-A*.c", "--header=A: 1", "--header", "B: 2", "-nc", "--no-iri", "-Q2k", "-e", "quota=1", "http://x/", "--", "-y"])
    assert c.recursive and c.level == -1 and c.accept == ["*.c"] and c.headers == ["A: 1", "B: 2"]
    assert c.no_clobber and not c.iri and c.quota == 1 and c.urls == ["http://x/", "-y"]
    assert parse_args(["--mirror", "--max-threads", "99"]).max_threads == 32
    for bad in (["--nonsense"], ["-Z"], ["-t"]):
        with pytest.raises(ConfigError):
            parse_args(bad)
