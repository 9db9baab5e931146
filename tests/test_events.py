import json

from nymora.sources import vault as vaults
from nymora.streaming import events

VAULT = '{"mappings":[{"type":"EMAIL","original":"a\\"b@c.org","surrogate":"⟨EMAIL_1⟩"}]}'


def run(spark, style, rows):
    df = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)], "stream_id string, n long, event string")
    return {r.key: r.text for r in events.restored(df, vaults.from_json(spark, VAULT), style).collect()}


def test_blocks_are_apart(spark):
    delta = lambda i, **d: {"type": "content_block_delta", "index": i, "delta": d}
    rows = [{"type": "message_start"}, delta(0, type="text_delta", text="to ⟨EM"), delta(1, type="input_json_delta", partial_json='{"k":"⟨EMA'), delta(0, type="text_delta", text="AIL_1⟩ or ⟨"), delta(1, type="input_json_delta", partial_json='IL_1⟩"}'), {"type": "content_block_stop", "index": 0}, {"type": "content_block_stop", "index": 1}]
    assert run(spark, "blocks", rows) == {"s/block-text/0": 'to a"b@c.org or ⟨', "s/block-json/1": '{"k":"a\\"b@c.org"}'}


def test_choices_and_tools_are_apart(spark):
    chunk = lambda i, reason=None, **d: {"choices": [{"index": i, "delta": d, "finish_reason": reason}]}
    tool = lambda i, a: {"tool_calls": [{"index": i, "function": {"arguments": a}}]}
    rows = [chunk(0, content="x ⟨EMAIL"), chunk(1, content="⟨EMAIL_1⟩"), chunk(0, content="_1⟩"), chunk(0, **tool(0, '{"a":"⟨EMAIL_')), chunk(0, **tool(1, '{"b":"1⟩"}')), chunk(0, **tool(0, '1⟩"}')), chunk(0, "stop"), chunk(1, "stop")]
    assert run(spark, "chat", rows) == {"s/0/content": 'x a"b@c.org', "s/1/content": 'a"b@c.org', "s/0/tool-json/0": '{"a":"a\\"b@c.org"}', "s/0/tool-json/1": '{"b":"1⟩"}'}


def test_items_are_apart(spark):
    text = lambda item, d: {"type": "response.output_text.delta", "item_id": item, "content_index": 0, "delta": d}
    rows = [text("a", "⟨EMAI"), text("b", "L_1⟩"), text("a", "L_1⟩"), {"type": "response.function_call_arguments.delta", "item_id": "c", "delta": '["⟨EMAIL_1⟩"]'}, {"type": "response.output_text.done", "item_id": "a", "content_index": 0}, {"type": "response.output_text.done", "item_id": "b", "content_index": 0}, {"type": "response.function_call_arguments.done", "item_id": "c"}]
    assert run(spark, "items", rows) == {"s/output_text/a/0": 'a"b@c.org', "s/output_text/b/0": "L_1⟩", "s/arguments-json/c/0": '["a\\"b@c.org"]'}
