"""Chat models behind HTTP as clients of the healing loop; the transport is a parameter."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from tessera.operators.heal import with_retry

TIMEOUT = 60.0


@dataclass(frozen=True)
class Reply:
    """An HTTP response: ``status``, ``headers`` and the decoded JSON ``body``."""

    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: Any = None


Send = Callable[[str, dict[str, str], dict[str, Any]], Reply]


def send_json(url: str, headers: dict[str, str], body: dict[str, Any]) -> Reply:
    """POST by the standard library; a connection that takes too long raises TimeoutError."""
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(asked, timeout=TIMEOUT) as got:
            return Reply(got.status, dict(got.headers), json.loads(got.read()))
    except urllib.error.HTTPError as e:
        return Reply(e.code, dict(e.headers))
    except urllib.error.URLError as e:
        raise (TimeoutError(str(e.reason)) if isinstance(e.reason, TimeoutError) else ConnectionError(str(e.reason))) from e


class Dialect(Protocol):
    """How a vendor's interface says the same things."""

    model: str
    key_name: str

    def address(self, model: str) -> str: ...
    def authorised(self, key: str) -> dict[str, str]: ...
    def question(self, model: str, messages: list[dict[str, str]], schema: dict[str, Any] | None) -> dict[str, Any]: ...
    def answer(self, body: dict[str, Any]) -> dict[str, Any]: ...


class GenerateContent:
    """The dialect with 'contents' of 'parts' and a separate system instruction."""

    # The public interface's address, names and defaults.
    model, key_name, base = "gemini-2.5-flash", "GEMINI_API_KEY", "https://generativelanguage.googleapis.com/v1beta/models"

    def address(self, model: str) -> str:
        return f"{self.base}/{model}:generateContent"

    def authorised(self, key: str) -> dict[str, str]:
        return {"x-goog-api-key": key}

    def question(self, model: str, messages: list[dict[str, str]], schema: dict[str, Any] | None) -> dict[str, Any]:
        said = [(m["role"], {"parts": [{"text": m["content"]}]}) for m in messages]
        body: dict[str, Any] = {"contents": [{"role": "user" if role == "user" else "model", **part} for role, part in said if role != "system"]}
        for role, part in said:
            if role == "system":  # of several the last one counts
                body["systemInstruction"] = part
        return body | ({"generationConfig": {"responseMimeType": "application/json", "responseSchema": schema}} if schema else {})

    def answer(self, body: dict[str, Any]) -> dict[str, Any]:
        best, used = body["candidates"][0], body.get("usageMetadata", {})
        return _answer(best["content"]["parts"][0]["text"], best.get("finishReason", "STOP"), used.get("promptTokenCount", 0), used.get("candidatesTokenCount", 0))


class ChatCompletions:
    """The dialect with 'messages' of roles and 'choices'."""

    # The public interface's address, names and defaults.
    model, key_name, url = "gpt-4o-mini", "OPENAI_API_KEY", "https://api.openai.com/v1/chat/completions"

    def address(self, model: str) -> str:
        return self.url

    def authorised(self, key: str) -> dict[str, str]:
        return {"Authorization": f"Bearer {key}"}

    def question(self, model: str, messages: list[dict[str, str]], schema: dict[str, Any] | None) -> dict[str, Any]:
        wanted = {"type": "json_schema", "json_schema": {"name": "extraction_schema", "strict": True, "schema": schema}}
        return {"model": model, "messages": [dict(m) for m in messages]} | ({"response_format": wanted} if schema else {})

    def answer(self, body: dict[str, Any]) -> dict[str, Any]:
        best, used = body["choices"][0], body.get("usage", {})
        return _answer(best["message"]["content"], best.get("finish_reason", "stop"), used.get("prompt_tokens", 0), used.get("completion_tokens", 0))


def _answer(text: str | None, reason: str, prompt: int, completion: int) -> dict[str, Any]:
    return {"text": text or "", "finish_reason": reason, "prompt_tokens": prompt, "completion_tokens": completion}


# The names by which the vendors' dialects are asked for.
DIALECTS: dict[str, type[Dialect]] = {"gemini": GenerateContent, "openai": ChatCompletions}


class ChatClient:
    """A client for ``heal``: asks in a vendor's dialect through ``send``, with retries.

    The key is a parameter or comes from the dialect's environment variable on the executor; it travels
    in headers only. Without a key, or with an unknown vendor, it raises.
    """

    supports_structured_output = True

    def __init__(self, vendor: str, model: str | None = None, key: str | None = None, send: Send = send_json, **retry: Any):
        if vendor not in DIALECTS:
            raise ValueError(f"unknown vendor {vendor!r}")
        self.dialect = DIALECTS[vendor]()
        self.model = model or self.dialect.model
        key = key or os.environ.get(self.dialect.key_name)
        if not key:
            raise ValueError(f"{self.dialect.key_name} is not set")
        self.send, self.retry, self.headers = send, retry, self.dialect.authorised(key)

    def complete(self, messages: list[dict[str, str]]) -> dict[str, Any]:
        return self._ask(messages, None)

    def complete_structured(self, messages: list[dict[str, str]], schema: dict[str, Any]) -> dict[str, Any]:
        return self._ask(messages, schema)

    def _ask(self, messages: list[dict[str, str]], schema: dict[str, Any] | None) -> dict[str, Any]:
        question = self.dialect.question(self.model, messages, schema)
        reply = with_retry(lambda: self.send(self.dialect.address(self.model), self.headers, question), **self.retry)
        if reply.status >= 400:
            raise ConnectionError(f"status {reply.status}")
        return self.dialect.answer(reply.body)

    def close(self) -> None:
        """Close the transport, if it can be closed."""
        if callable(close := getattr(self.send, "close", None)):
            close()

    def __enter__(self) -> ChatClient:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
