"""Small synthetic exports."""

import json

VERSION = "sample-import/v1"


def manifest(**changes):
    """Two conversations, four messages, two attachments of which one file exists."""
    document = {
        "schema_version": VERSION,
        "exported_at": "2026-08-30T10:00:00+08:00",
        "source": {"kind": "demo", "account_id": "acct-1", "display_name": "Demo account"},
        "conversations": [
            {
                "source_conversation_id": "room-1",
                "title": "Club room",
                "type": "group",
                "participants_complete": True,
                "metadata": {"unread_count": 3, "is_hidden": False},
                "group": {"member_count": 2, "announcement": "be kind"},
                "participants": [
                    {"source_identity_id": "u-zoe", "display_name": "Zoe", "role": "member"},
                    {"source_identity_id": "u-me", "display_name": "Me", "is_self": True, "role": "owner"},
                ],
                "messages": [
                    {
                        "source_message_id": "g1", "timestamp": "2026-08-30T09:00:00+08:00", "sender_id": "u-zoe",
                        "sender_name": "Zoe", "direction": "incoming", "metadata": {"seq": 1},
                        "parts": [{"type": "text", "text": "Meeting at 50% capacity_A", "tone": "calm"}],
                    },
                    {
                        "source_message_id": "g2", "timestamp": "2026-08-30T09:01:00+08:00", "sender_id": "u-me",
                        "sender_name": "Me", "direction": "outgoing",
                        "parts": [{"type": "file", "path": "files/plan.txt", "mime_type": "text/plain"}],
                    },
                    {
                        "source_message_id": "g3", "timestamp": "2026-08-30T09:02:00+08:00", "sender_id": "u-zoe",
                        "sender_name": "Zoe", "direction": "incoming",
                        "parts": [{"type": "audio", "path": "files/gone.silk", "transcription": "spoken words"}],
                    },
                ],
            },
            {
                "source_conversation_id": "dm-1",
                "title": "Ann",
                "participants": [{"source_identity_id": "u-ann", "display_name": "Ann"}],
                "messages": [
                    {
                        "source_message_id": "d1", "timestamp": "2026-08-30T01:30:00Z", "sender_id": "u-ann",
                        "parts": [{"type": "link", "url": "https://example.org/x"}],
                    }
                ],
            },
        ],
    }
    document.update(changes)
    return document


def write(folder, document, name="export.json"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "files").mkdir(exist_ok=True)
    (folder / "files" / "plan.txt").write_text("the plan")
    (folder / name).write_text(document if isinstance(document, str) else json.dumps(document, ensure_ascii=False))
    return str(folder)
