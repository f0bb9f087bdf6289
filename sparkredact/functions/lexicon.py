"""Word lists of the detectors. Results depend on exactly these entries."""

CATEGORIES = (
    "person_name organization_name phone_number url email money_amount percent_value api_key access_token secret thai_national_id date_of_birth thai_address bank_account license_plate passport_number job_title credit_card ip_address iban crypto_wallet"
).split()

THAI_NAME_LABELS = ["ชื่อตัวและชื่อสกุล", "ชื่อตัวและชื่อสกุ", "ชื่อตัว", "ชื่อสกุล", "ชื่อ-สกุล", "ชื่อ-นามสกุล", "นามสกุล", "ชื่อ"]
THAI_HONORIFICS_DEGRADED = ["น.ส.", "น.ส", "นส.", "น.ส ", "น. ส", "น.", "นาย", "นาง", "ด.ช.", "ด.ญ."]
THAI_HONORIFICS = ["นาย", "นางสาว", "นาง", "เด็กชาย", "เด็กหญิง", "ด.ช.", "ด.ญ.", "ดร.", "คุณ"]
THAI_ORG_WORDS = ["บริษัท", "ห้างหุ้นส่วนจำกัด", "ห้างหุ้นส่วน", "จำกัด", "มหาชน", "องค์การ", "มูลนิธิ", "สมาคม", "ธนาคาร"]
LATIN_ORG_WORDS = "inc ltd llc llp plc corp corporation co company gmbh group holdings limited incorporated".split()

THAI_JOB_TITLES = [
    "ผู้อำนวยการ", "รองผู้อำนวยการ", "ผู้ช่วยผู้อำนวยการ", "กรรมการผู้จัดการ", "รองกรรมการผู้จัดการ", "ผู้จัดการ", "รองผู้จัดการ", "ผู้ช่วยผู้จัดการ", "ประธานกรรมการ", "ประธานเจ้าหน้าที่บริหาร",
    "ประธาน", "รองประธาน", "กรรมการ", "เลขานุการ", "เหรัญญิก", "หัวหน้าฝ่าย", "หัวหน้างาน", "หัวหน้า", "ผู้บริหาร", "ผู้อำนวยการฝ่าย",
    "นักวิชาการเงินและบัญชี", "นักวิชาการ", "เจ้าหน้าที่", "พนักงาน", "อธิการบดี", "รองอธิการบดี", "คณบดี", "รองคณบดี", "ศาสตราจารย์", "รองศาสตราจารย์",
    "ผู้ช่วยศาสตราจารย์", "อาจารย์", "ปลัด", "รองปลัด", "อธิบดี", "รองอธิบดี", "ผู้ว่าราชการ", "นายกเทศมนตรี", "กำนัน", "ผู้ใหญ่บ้าน",
]
LATIN_JOB_PHRASES = [
    "vice president", "senior vice president", "executive vice president", "assistant vice president", "vice-president", "managing director", "deputy managing director", "executive director", "board of directors", "chief executive officer",
    "chief financial officer", "chief operating officer", "chief technology officer", "chief marketing officer", "general manager", "deputy manager", "assistant manager", "vice chancellor", "vice-chancellor",
]
LATIN_JOB_WORDS = "director president manager ceo cfo coo cto cmo chairman chairperson secretary treasurer supervisor officer executive dean rector chancellor governor mayor commissioner professor lecturer".split()

GIVEN_NAMES = "john jane james mary robert michael william david richard susan sarah emma olivia liam noah somchai somsak wichai anong malee".split()
PERSON_TITLES = "mr mrs ms miss dr prof sir madam mx mies mis miass rniss".split()
#: In the order in which they are taken out of a text.
NAME_LABELS = ["last name", "lastname", "first name", "firstname", "full name", "given name", "name", "namo"]

TOP_LEVEL_DOMAINS = "com net org io co gov edu info biz dev app ai th uk us".split()
CURRENCY_SYMBOLS, CURRENCY_CODES, BAHT = "฿$€£¥", "THB USD EUR GBP JPY".split(), "บาท"

THAI_MONTHS = [
    "ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค.",
    "มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม",
]
LATIN_MONTHS = "jan feb mar apr may jun jul aug sep sept oct nov dec january february march april june july august september october november december".split()
THAI_ADDRESS_WORDS = ["บ้านเลขที่", "เลขที่", "หมู่ที่", "หมู่บ้าน", "ซอย", "ถนน", "ตำบล", "แขวง", "อำเภอ", "เขต", "จังหวัด", "หมู่"]
