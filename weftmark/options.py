"""Job options (S6, F2), resolved once on the driver and passed to the plan as literals.

Executors never read the environment: a value comes from the request column,
else from these options, else from the constant default.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

# Fixed values (defaults the reference uses).
DEFAULT_ACCEPT_HEADER = "text/markdown, text/plain;q=0.99, text/html;q=0.9, */*;q=0.8"
DEFAULT_SUMMARY_HOST = "http://localhost:11434"
DEFAULT_SUMMARY_MODEL = "gpt-oss:20b"
DEFAULT_WAIT_TIME = 2000
DEFAULT_SCROLL = True
DEFAULT_TRUNCATE = True
DEFAULT_MAX_LENGTH = 100000
DEFAULT_USE_SUMMARIZATION = False

ENV_ACCEPT = "WEFTMARK_ACCEPT_HEADER"
ENV_HOST = "WEFTMARK_SUMMARY_HOST"
ENV_MODEL = "WEFTMARK_SUMMARY_MODEL"
ENV_TARGET = "WEFTMARK_SUMMARY_TOKENS"


def _int_or_none(v: str | None) -> int | None:
    if not v:
        return None
    try:
        return int(v)
    except ValueError:
        return None


@dataclass(frozen=True)
class JobOptions:
    accept_header: str = DEFAULT_ACCEPT_HEADER
    summary_host: str | None = None
    summary_model: str | None = None
    summary_target_tokens: int | None = None
    # H6: consent/banner nodes need rendered height; off unless asked for
    prune_consent_nodes: bool = False
    # H5: the browser-side cleanup of the render route
    prune_page_chrome: bool = True

    @staticmethod
    def from_env(environ: dict | None = None, **overrides) -> "JobOptions":
        env = os.environ if environ is None else environ
        accept = (env.get(ENV_ACCEPT) or "").strip() or DEFAULT_ACCEPT_HEADER
        base = dict(
            accept_header=accept,
            summary_host=env.get(ENV_HOST) or None,
            summary_model=env.get(ENV_MODEL) or None,
            summary_target_tokens=_int_or_none(env.get(ENV_TARGET)),
        )
        base.update(overrides)
        return JobOptions(**base)

    @property
    def native_enabled(self) -> bool:
        """the native markdown route runs only if Accept asks for markdown."""
        return "text/markdown" in self.accept_header.lower()

    @property
    def host(self) -> str:
        return self.summary_host or DEFAULT_SUMMARY_HOST

    @property
    def model(self) -> str:
        return self.summary_model or DEFAULT_SUMMARY_MODEL
