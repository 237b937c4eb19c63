"""SRC-16: a folder to try the engine on: lists, a configuration that names them, and an invented log."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from rangewarden.sources.synth import FORMAT, synthetic_log

FILES = {
    "whitelist.txt": "# ranges that are never banned\n35.217.0.0/16   # a partner\n",
    "blacklist.txt": "# ranges that are always banned\n198.51.100.0/24\n",
    "ua_whitelist.txt": "Googlebot/2.1 (+http://www.google.com/bot.html)\nMozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)\n",
    "ua_blacklist.txt": "Anubis-OGTag-Fetcher/1.0\n",
}
CONFIG = """[global]
jailFile = "{d}/jail.json"
banFile = "{d}/ban.txt"
whitelist = "{d}/whitelist.txt"
blacklist = "{d}/blacklist.txt"
userAgentWhitelist = "{d}/ua_whitelist.txt"
userAgentBlacklist = "{d}/ua_blacklist.txt"

[static]
logFile = "{d}/access.log"
logFormat = '{f}'
plotPath = "{d}/traffic.html"

[static.all_traffic]
clusterArgSets = [[1000, 8, 16, 0.5], [200, 16, 24, 0.2]]
useForJail = [false, true]

[static.scripts]
useragentRegex = "curl|python"
clusterArgSets = [[200, 16, 24, 0.3]]
useForJail = [true]

[static.first_pages]
endpointRegex = "^/fake-endpoint-[1-9]$"
clusterArgSets = [[500, 12, 20, 0.3]]
"""


def scaffold(spark: SparkSession, folder: str, lines: int = 1_000_000, seed: int = 42) -> list[str]:
    """Writes the folder's files and returns their paths; refuses if one of them is there."""
    to = Path(folder).resolve()
    names = [*FILES, "static.toml", "access.log"]
    if there := [n for n in names if (to / n).exists()]:
        raise FileExistsError(f"{to} already holds {', '.join(there)}")
    to.mkdir(parents=True, exist_ok=True)
    for name, text in FILES.items():
        (to / name).write_text(text, encoding="utf-8")
    (to / "static.toml").write_text(CONFIG.format(d=to, f=FORMAT), encoding="utf-8")
    synthetic_log(spark, lines, seed).write.text(str(to / "access.log"))
    return [str(to / n) for n in names]
