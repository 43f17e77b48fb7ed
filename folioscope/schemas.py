"""Fixed schemas of the stored entities; nothing is inferred."""

PAGES = "document_id string, page_number int, text string"
SPAN = "struct<text:string,size:double,font:string>"
LAYOUT = f"document_id string, page_number int, block_no int, line_no int, spans array<{SPAN}>"
BOOKMARKS = "document_id string, ord int, level int, title string, page_number int"
SECTIONS = (
    "document_id string, ord bigint, section_id string, section_title string, "
    "start_page int, end_page int"
)
CHUNKS = (
    "chunk_id string, document_id string, document_name string, pdf_file string, "
    "section_id string, section_title string, page_start int, page_end int, "
    "token_count int, text string"
)
EMBEDDED_CHUNKS = CHUNKS + ", embedding array<float>, embedding_model string"
POINTS = (
    "point_id string, embedding array<float>, payload struct<chunk_id:string,"
    "document_id:string,document_name:string,pdf_file:string,section_id:string,"
    "section_title:string,page_start:int,page_end:int,token_count:int,text:string>"
)
REGISTRY = (
    "document_id string, document_name string, organization string, version string, "
    "source_url string, topic string, local_file string, status string, "
    "total_chunks int, total_pages int"
)
TEST_SET = (
    "query_id string, query string, expected_section_id string, "
    "expected_chunk_ids array<string>, expected_pages array<int>, topic string, "
    "clinical_intent string"
)
VITALS = (
    "patient_name string, age int, gender string, systolic int, diastolic int, "
    "heart_rate int, bp_category string, comorbidities array<string>, "
    "medications array<string>, lab_values map<string,string>, clinical_summary string"
)
ISSUES = "level string, check string, chunk_id string, message string"
USERS = "id string, name string, email string, password_hash string, created_at bigint"
USER_CHATS = "id string, user_id string, title string, data_json string, updated_at bigint"
PATIENT_REPORTS = (
    "id string, user_id string, filename string, vitals_json string, "
    "summary_text string, uploaded_at bigint"
)
