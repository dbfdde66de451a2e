"""Settings, addresses and answers of services that can be plugged in."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import takewhile
from pathlib import Path

# Where chat completions are asked for, and which ports a service may have.
COMPLETIONS = "/chat/completions"
PORTS = range(1, 65536)


def endpoint(base: str) -> str:
    """The address of chat completions, its last part added once."""
    address = base.strip().rstrip("/")
    return address if address.endswith(COMPLETIONS) else address + COMPLETIONS


def text_of(content: str | list | None) -> str:
    """A text, or the texts of a list of blocks."""
    if isinstance(content, list):
        return "".join(b if isinstance(b, str) else b.get("text") or "" for b in content if isinstance(b, str | dict))
    return content or ""


def invalid_settings(settings: dict) -> dict[str, str]:
    """What is wrong with settings by name; all are checked before any is used."""
    wrong = {}
    for name, value in settings.items():
        if name.endswith("url") and value and not re.match(r"https?://[^\s/]+", str(value)):
            wrong[name] = "no http address"
        if name.endswith("port") and not (isinstance(value, int) and not isinstance(value, bool) and value in PORTS):
            wrong[name] = "no port"
    return wrong


def secret(name: str, env: dict[str, str] | None = None) -> str | None:
    """A key, from the environment only; files of settings never hold one."""
    return (os.environ if env is None else env).get(name) or None


@dataclass(frozen=True)
class Provider:
    """How a model is asked and its answer read; ``send(url, body)`` gives the lines of a stream."""

    base: str
    model: str
    send: Callable[[str, str], Iterable[str]]

    def request(self, text: str, temperature: float = 0.2, max_tokens: int = 8192) -> tuple[str, str]:
        body = {"model": self.model, "messages": [{"role": "user", "content": text}], "temperature": temperature, "max_tokens": max_tokens, "stream": True}
        return endpoint(self.base), json.dumps(body, ensure_ascii=False, sort_keys=True)

    def __call__(self, text: str) -> str:
        """The whole answer; an error in the stream is raised."""
        bodies = (line.strip()[5:].strip() for line in self.send(*self.request(text)) if line.strip().startswith("data:"))
        said = [_loaded(body) for body in takewhile(lambda body: body != "[DONE]", bodies)]
        if wrong := next((e for e in (at(x, "error") for x in said) if e), None):
            raise RuntimeError(at(wrong, "message") or str(wrong))
        contents = (at(x, "choices", 0, "delta", "content") or "" for x in said)
        return "".join(c if isinstance(c, str) else "".join(at(part, "text") or "" for part in c) for c in contents)


def _loaded(body: str) -> object:
    try:
        return json.loads(body)
    except ValueError:
        return None


def at(value: object, *path: str | int) -> object:
    """What stands at a path of names and places; None where there is nothing."""
    for step in path:
        try:
            value = value[step]
        except (KeyError, IndexError, TypeError):
            return None
    return value


def transcriber(command: list[str], suffix: str = ".txt", timeout: float = 3600) -> Callable[[str], str]:
    """A function from an audio file's path to its text, by a program that writes it beside the file.

    ``{path}`` in the command is the file.  A program that fails or writes nothing
    is an error, so its file stays for another try.
    """

    def run(path: str) -> str:
        subprocess.run([part.format(path=path) for part in command], check=True, capture_output=True, timeout=timeout)
        return Path(path).with_suffix(suffix).read_text(encoding="utf-8")

    return run


def seed(text: str) -> tuple[str, str]:
    """Title and body of a seed text: the first line, its heading mark left out, and the rest."""
    first, _, rest = text.strip().partition("\n")
    return first.lstrip("#").strip(), rest.strip()
