"""Table layouts: tokens, detections, masters, ground truth and the nested result."""

TOKENS = "doc_id long, tok_idx int, text string, x1 int, y1 int, x2 int, y2 int, conf double"
DETECTIONS = "doc_id long, seq long, cls string, x1 int, y1 int, x2 int, y2 int, conf double"
PAGES = "doc_id string, page_index int, page_count int, page_height int, page_width int, embedded_text string, relevance_score double"
DEALERS = "version int, entries array<struct<canonical: string, aliases: array<string>, frequency: int>>"
ASSETS = "version int, entries array<struct<brand: string, model: string, full_name: string>>"
LABELS = (
    "documents array<struct<doc_id: string, fields: struct<dealer_name: string, model_name: string, horse_power: int, "
    "asset_cost: bigint, signature_present: boolean, stamp_present: boolean>>>"
)
FIELD = "struct<value: string, confidence: double>"
VISUAL = "struct<present: boolean, bbox: array<int>, confidence: double>"
RESULT = (
    f"doc_id string, fields struct<dealer_name: {FIELD}, model_name: {FIELD}, horse_power: struct<value: int, confidence: double>, "
    f"asset_cost: struct<value: bigint, confidence: double>, signature: {VISUAL}, stamp: {VISUAL}>, "
    "confidence double, processing_time_sec double, cost_estimate_usd double, error string"
)
STORE = "id string, fileName string, dealerName string, modelName string, status string, confidence int, processingTime string, uploadedAt string, seq long"
YOLO = "image string, line string"
