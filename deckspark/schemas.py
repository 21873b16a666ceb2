"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from deckspark.functions.formats import BOARDS

# Raw card objects of the bulk export. Flags come in several JSON types, hence VARIANT.
CARD_EXPORT = (
    "name string, id string, oracle_id string, layout string, mana_cost string, cmc double, "
    "type_line string, oracle_text string, power string, toughness string, loyalty string, "
    "defense string, colors array<string>, color_identity array<string>, rarity string, "
    "reserved variant, textless variant, game_changer variant, edhrec_rank int, "
    "image_uris map<string,string>, card_faces array<struct<image_uris: map<string,string>>>, "
    "keywords array<string>, legalities map<string,string>"
)

# Formats that have a legality column on the card table.
LEGALITIES = ("commander", "pauper", "modern", "vintage", "legacy")

# The flat card table, without and with its id.
CARD_COLUMNS = (
    "card_name", "scryfall_id", "oracle_id", "layout", "mana_cost", "cmc", "type_line",
    "oracle_text", "power", "toughness", "loyalty", "defense", "color_mask", "ci_mask", "rarity",
    "reserved", "textless", "game_changer", "edhrec_rank", "image_uri", "keywords_json",
    *[f"legal_{name}" for name in LEGALITIES],
)

CARDS = (
    "id int, card_name string, scryfall_id string, oracle_id string, layout string, "
    "mana_cost string, cmc float, type_line string, oracle_text string, power string, "
    "toughness string, loyalty string, defense string, color_mask int, ci_mask int, "
    "rarity string, reserved short, textless short, game_changer short, edhrec_rank int, "
    "image_uri string, keywords_json string, legal_commander string, legal_pauper string, "
    "legal_modern string, legal_vintage string, legal_legacy string"
)

BULK_MANIFEST = "type string, download_uri string"

CARD_FORMAT_STATUS = (
    "card_id int, format string, swept boolean, ever_swept boolean, "
    "claimed_at timestamp, claimed_by string"
)

#: What a column added later holds in rows that were written before it existed.
STATUS_DEFAULTS = {"swept": "false", "ever_swept": "false"}

DECKS = (
    "format string, moxfield_id string, name string, author string, color_mask int, "
    "created_at_utc timestamp, updated_at_utc timestamp, scraped_at timestamp, "
    "cards_fetched_at timestamp, status string, claimed_at timestamp, claimed_by string, "
    "card_ids array<int>, commander_ids array<int>"
)

DECK_CARDS = "format string, moxfield_id string, card_id int, board string, quantity int"

# Logs the streams append to, one folder per micro-batch.
STUB_LOG = (
    "moxfield_id string, name string, format string, author string, color_mask int, "
    "created_at_utc timestamp, updated_at_utc timestamp, scraped_at timestamp, "
    "sweep_card string, sweep_format string, page int, seq bigint, pos int, batch bigint"
)

# What is needed to pack a deck again when its unresolved names get cards; null where all have one.
_OPEN = (
    "struct<entries: array<struct<pos: int, card_id: int, board: string, quantity: int>>, "
    "missing: array<struct<pos: int, card_name: string, board: string, quantity: int>>>"
)

#: Decks whose present contents have unresolved names.
OPEN_DECKS = f"format string, moxfield_id string, open {_OPEN}"

# ``stub_batches`` is how many batches of stubs had been logged when the submission was judged.
SUBMISSION_LOG = (
    "format string, moxfield_id string, seq bigint, fetched_at timestamp, error boolean, "
    "card_ids array<int>, commander_ids array<int>, "
    "bridge array<struct<card_id: int, board: string, pos: int, quantity: int>>, "
    f"unresolved array<string>, n_rows int, doc bigint, stub_batches bigint, batch bigint, open {_OPEN}"
)

# What was handed out and finished: ``claim`` and ``complete`` of sweeps, ``claim`` of decks, ``reset`` of the cycle. The
# batch is the fence of a hand-out; the last two columns say how far the other logs were at that time.
WORK_LOG = (
    "kind string, card_id int, format string, moxfield_id string, holder string, at timestamp, request string, "
    "stub_batches bigint, submission_batches bigint, batch bigint"
)

# Failures of fetching a deck since its last report.
ATTEMPT_STATE = "format string, moxfield_id string, failures int"

# Where the sweeps stand of which pages have been read: the present run and the page at which it ended, if it has.
SWEEP_STATE = "sweep_card string, sweep_format string, run bigint, last_page int"

UNKNOWN_CARDS = "ts timestamp, format string, moxfield_id string, card_name string"

# A landed search page: the request it answers, then the envelope as received.
SEARCH_PAGE = (
    "card_name string, format string, mode string, page int, fetched_at timestamp, seq bigint, "
    "totalPages int, data array<struct<"
    "publicId: string, id: string, slug: string, name: string, format: string, "
    "createdByUser: struct<userName: string>, authorUserName: string, "
    "colorIdentity: array<string>, colors: array<string>, "
    "createdAtUtc: string, lastUpdatedAtUtc: string>>"
)

_BOARD = "map<string, struct<quantity: int, card: struct<name: string>>>"

# A landed deck document, or the report that fetching it failed.
DECK_DETAIL = "format string, moxfield_id string, fetched_at timestamp, seq bigint, error boolean, " + ", ".join(
    f"{board} {_BOARD}" for board in BOARDS
)

CORRUPT = "_corrupt_record"


def with_corrupt(schema: str) -> str:
    return f"{schema}, {CORRUPT} string"
