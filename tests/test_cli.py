import json

import pytest

from rangewarden import cli
from rangewarden.plans.config import ConfigError


def test_flags_and_files_exclude_each_other(tmp_path):
    args = cli.parser().parse_args(["static", "--config", "x.toml", "--log-file", "y"])
    with pytest.raises(ConfigError, match="excludes --log-file"):
        cli.configured(args)
    config = cli.configured(cli.parser().parse_args(["live", "--port", "5044", "--cluster-set", "10,8,24,0.5", "--max-age", "90m"]))
    assert config.windows[0].max_age.total_seconds() == 5400 and config.windows[0].sets[0].use_for_jail
    assert cli.main(["static", "--log-file", str(tmp_path / "none")]) == 1


def test_generate_then_analyse(spark, tmp_path, capsys):
    assert cli.main(["generate", str(tmp_path / "demo"), "--lines", "3000"]) == 0
    with pytest.raises(FileExistsError):
        cli.main(["generate", str(tmp_path / "demo")])
    capsys.readouterr()
    assert cli.main(["static", "--config", str(tmp_path / "demo" / "static.toml"), "--compact"]) == 0
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["general"]["total_requests"] == 3000 and len(report["tries"]) == 3
    assert "198.51.100.0/24" in (tmp_path / "demo" / "ban.txt").read_text()
