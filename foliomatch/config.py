"""Tunables and word lists of document comparison."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    ocr_confidence: float = 0.2
    ocr_dpi: int = 300
    output_dpi: int = 150
    min_word_length: int = 2
    min_native_words: int = 5
    fuzzy_default: float = 0.70
    fuzzy_strict: float = 0.80
    fuzzy_loose: float = 0.60
    force_ocr: bool = True
    samples: int = 10


CONFIG = Config()

# Words that never count as significant.
STOPWORDS = (
    "นาย", "นาง", "นางสาว", "ถนน", "ซอย", "แขวง", "เขต", "หมู่", "วันที่", "เดือน", "พ.ศ.", "บาท",
    "mr", "mrs", "miss", "ms", "road", "soi", "district", "province",
    "the", "a", "an", "is", "are", "of", "to", "in", "for", "on", "with",
)
# Form labels that count only as whole words.
LABELS_EXACT = (
    "u", "hr", "น", "baht", "sq", "m2", "to", "from", "no", "of", "as", "at", "on", "per",
    "sum", "vat", "tax", "net", "rate", "area", "code", "และ", "หรือ", "and", "or", "ที่", "ณ",
)
# Form labels that, from four characters on, also count inside a word.
LABELS_PARTIAL = (
    "เวลา", "time", "เริ่มต้น", "สิ้นสุด", "ตำแหน่ง", "จังหวัด", "อำเภอ", "ตำบล", "รหัสไปรษณีย์",
    "district", "province", "subdistrict", "block", "บล็อก", "ตารางที่", "รายการที่", "ลำดับที่", "itemno",
    "รายละเอียด", "description", "จำนวนเงิน", "amount", "ความเสียหาย", "deductible", "ส่วนแรก", "excess",
    "จำนวนชั้น", "จำนวนอาคาร", "จำนวนห้อง", "storey", "building", "พื้นที่", "ภายใน", "internal", "total",
    "สถานที่", "occupancy", "รหัสภัย", "riskcode", "ชั้นของ", "class", "สิ่งปลูกสร้าง", "construction",
    "เจ้าของ", "owner", "ผู้เช่า", "tenant", "เบี้ยประกัน", "premium", "อากรแสตมป์", "stamp", "duty",
    "ภาษี", "รวม", "สุทธิ", "อัตรา", "เงื่อนไข", "condition", "clause", "ข้อตกลง", "agreement",
    "วันที่ทำ", "issued", "made", "ตัวแทน", "agent", "นายหน้า", "broker", "ใบอนุญาต", "license",
    "โดยตรง", "direct", "กรมธรรม์", "policy",
)
# What a form label may begin with.
LABEL_PREFIXES = (
    "รายละเอียด", "จำนวน", "พื้นที่", "สถานที่", "ชั้นของ", "description", "amount", "number", "location",
    "ความเสียหาย", "อัตรา", "เงื่อนไข", "ข้อตกลง",
)
# Thai month names, full, dotted and undotted, each from January to December.
MONTHS = (
    "มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม",
    "ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค.",
    "มค", "กพ", "มีค", "เมย", "พค", "มิย", "กค", "สค", "กย", "ตค", "พย", "ธค",
)
# Phrases that put a text in the context of dates.
DATE_KEYWORDS = (
    "ระยะเวลาประกันภัย", "วันที่", "วันทำสัญญา", "สิ้นสุดวันที่", "เริ่มต้นวันที่", "ตั้งแต่วันที่", "ถึงวันที่",
    "วันทำสัญญาประกันภัย", "วันที่ทำสัญญา", "period of insurance", "from", "agreement made on", "policy issued",
    "เริ่มต้น", "สิ้นสุด", "เวลา",
)
# Thai number words, units and words for money.
NUMBER_WORDS = ("หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า", "สิบ", "เอ็ด", "ยี่", "ศูนย์")
NUMBER_UNITS = ("ร้อย", "พัน", "หมื่น", "แสน", "ล้าน", "สิบ")
MONEY_WORDS = ("บาท", "สตางค์", "ถ้วน")
# Colours and opacities of highlights by mode and side (1: first document).
STYLES = {("same", 1): (0.0, 0.8, 0.0, 0.35), ("same", 2): (0.0, 0.8, 0.0, 0.35), ("diff", 1): (1.0, 0.3, 0.3, 0.4), ("diff", 2): (0.3, 0.8, 0.3, 0.4)}

THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
TONES = "่้๊๋"
