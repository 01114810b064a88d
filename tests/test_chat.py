import json

import pytest
from pydantic import create_model

from tessera.operators import heal
from tessera.sources import chat

ASK = [{"role": "system", "content": "be brief"}, {"role": "user", "content": "who?"}, {"role": "assistant", "content": "me"}]
GEMINI = {"candidates": [{"content": {"parts": [{"text": '{"n": 1}'}]}, "finishReason": "MAX_TOKENS"}], "usageMetadata": {"promptTokenCount": 4, "candidatesTokenCount": 2}}
OPENAI = {"choices": [{"message": {"content": '{"n": 1}'}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 4, "completion_tokens": 2}}


class Wire:
    def __init__(self, *replies):
        self.replies, self.sent, self.closed = list(replies), [], False

    def __call__(self, url, headers, body):
        self.sent.append((url, headers, json.loads(json.dumps(body))))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    def close(self):
        self.closed = True


def test_generate_content():
    wire = Wire(chat.Reply(200, {}, GEMINI), chat.Reply(200, {}, {"candidates": [{"content": {"parts": [{"text": "x"}]}}]}))
    with chat.ChatClient("gemini", key="k1", send=wire) as client:
        assert client.complete_structured(ASK, {"type": "object"}) == {"text": '{"n": 1}', "finish_reason": "MAX_TOKENS", "prompt_tokens": 4, "completion_tokens": 2}
        assert client.complete(ASK) == {"text": "x", "finish_reason": "STOP", "prompt_tokens": 0, "completion_tokens": 0}
    url, headers, body = wire.sent[0]
    assert "k1" not in url and url.endswith("gemini-2.5-flash:generateContent") and headers == {"x-goog-api-key": "k1"} and wire.closed
    assert [c["role"] for c in body["contents"]] == ["user", "model"] and body["systemInstruction"]["parts"][0]["text"] == "be brief"
    assert body["generationConfig"]["responseSchema"] == {"type": "object"} and "generationConfig" not in wire.sent[1][2]


def test_chat_completions():
    wire = Wire(chat.Reply(429, {"Retry-After": "7"}), TimeoutError(), chat.Reply(200, {}, OPENAI), chat.Reply(200, {}, {"choices": [{"message": {"content": None}}]}), chat.Reply(401))
    waits = []
    client = chat.ChatClient("openai", "m", "k2", wire, sleep=waits.append)
    assert client.complete_structured(ASK, {"type": "object"})["text"] == '{"n": 1}'
    assert 7 <= waits[0] <= 7.7 and len(waits) == 2
    assert client.complete(ASK) == {"text": "", "finish_reason": "stop", "prompt_tokens": 0, "completion_tokens": 0}
    assert wire.sent[0][1] == {"Authorization": "Bearer k2"} and wire.sent[0][2]["messages"] == ASK and wire.sent[0][2]["response_format"]["json_schema"]["strict"]
    assert "response_format" not in wire.sent[3][2]
    with pytest.raises(ConnectionError, match="401"):
        client.complete(ASK)


def test_keys_and_vendors(monkeypatch):
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="GEMINI_API_KEY"):
        chat.ChatClient("gemini")
    with pytest.raises(ValueError, match="vendor"):
        chat.ChatClient("other", key="k")
    monkeypatch.setenv("OPENAI_API_KEY", "from-environment")
    assert chat.ChatClient("openai").headers == {"Authorization": "Bearer from-environment"}


def test_a_client_heals():
    model = create_model("Counted", n=(int, ...))
    bad = {"choices": [{"message": {"content": '{"n": "many"}'}}]}
    wire = Wire(chat.Reply(200, {}, bad), chat.Reply(200, {}, OPENAI))
    got = heal.run_one("count", model, chat.ChatClient("openai", key="k", send=wire))
    assert got["success"] and got["attempts"] == 2 and got["total_tokens"] == {"prompt_tokens": 4, "completion_tokens": 2}


def test_dates_as_retry_after():
    from datetime import UTC, datetime, timedelta
    from email.utils import format_datetime

    soon = format_datetime(datetime.now(UTC) + timedelta(seconds=30), usegmt=True)
    assert 25 <= heal.wait_seconds(soon, 1.0) <= 31
    assert heal.wait_seconds(format_datetime(datetime.now(UTC) - timedelta(days=1), usegmt=True), 1.0) == 0.0
