"""Entities and tunable constants. Every entity is a flat table keyed by `video_id`; times are numbers of one unit."""

from __future__ import annotations

from dataclasses import dataclass

SCHEMA_VERSION = 1

#: The thresholds of the completeness gate and of the sequence operators, in seconds where they are times.
MAX_GAP_SEC = 60.0
CUE_MAX_COVER_SEC = 30.0
SCENE_BINS = 20
FRAME_CARRY_MAX_SEC = 120.0
SAMPLE_FPS = 2.0
LONG_VIDEO_SEC = 2700.0
SLIDE_MIN_CHARS = 12
MIN_GROWTH = 0.15
PHASH_DISTANCE, PHASH_PERSISTENCE = 12, 2
HIST_SAME, SSIM_SAME = 0.90, 0.92
MIN_CAPTIONS, MIN_CAPTION_CHARS = 3, 20

SEGMENTS = "video_id string, seq int, t double, text string"
SPANS = "video_id string, s double, e double"
FRAMES = "video_id string, idx int, t double, image_path string, ocr_text string, is_slide boolean, phash bigint, ts_source string, sample_fps double"
SLIDES = "video_id string, idx int, t double, frame string, ocr_text string"
VIDEOS = "video_id string, title string, url string, duration_sec double, language string, source string"
RUNS = "index int, url string, status string, output_dir string, coverage_json string, notes_md string, error string, updated_at double"


@dataclass(frozen=True)
class Contract:
    """Markers and section anchors of generated notes, in their order. All are parameters of the operators that use them."""

    marker: str = "<!-- notes:generated -->"
    intro_marker: str = "<!-- notes:intro -->"
    #: Headings and placeholder of the note format.
    open_marker: str = "<!-- 미보강 -->"
    intro_title: str = "도입"
    whole_title: str = "전체"
    slide_title: str = "슬라이드"
    takeaway: str = "## 3줄 요약"
    toc: str = "## 목차"
    flow: str = "## 흐름"
    concepts: str = "## 핵심 개념·이론"
    detail: str = "## 정리 노트"
    questions: str = "## 복습 질문"
    coverage: str = "## 정리 커버리지"

    @property
    def anchors(self) -> list[str]:
        return [self.takeaway, self.toc, self.flow, self.concepts, self.detail, self.questions, self.coverage]


CONTRACT = Contract()
