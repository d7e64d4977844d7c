"""Secrets behind runs of spaces and tabs."""

import time

from loomspark.llm import secrets


def test_secrets_behind_runs_of_spaces_and_tabs():
    for gap in ("", " ", " " * 9, " " * 40, "\t", "\t\t", " \t "):
        for text, value in ((f"db_password{gap}={gap}h#9K!q@z7$Lw", "h#9K!q@z7$Lw"), (f"db_password:{gap}h#9K!q@z7$Lw", "h#9K!q@z7$Lw"), (f"passphrase{gap}:{gap}kX93jfQ0zzLm2", "kX93jfQ0zzLm2"), (f"auth:{gap}Bearer{gap or ' '}kX93jfQ0zzLm2", "kX93jfQ0zzLm2")):
            assert (text.index(value), len(text), "guess") in secrets.scan(text), text
            assert value not in secrets.redact(text, secrets.scan(text))
    began = time.perf_counter()
    secrets.scan(("pwd" + " " * 100_000) * 20 + "passphrase:" + "\t" * 1_000_000)
    assert time.perf_counter() - began < 5
