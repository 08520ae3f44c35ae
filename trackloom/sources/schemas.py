"""Schemas of the stored documents, with the values that stand in for missing fields."""

from __future__ import annotations

SEGMENT = "id string, startTime double, endTime double, confidence double, quality double, detectionCount int, averageTrajectoryLength double, ballSizeTrend double"
STATS = "totalFrames int, processedFrames int, detectionFrames int, trackingFrames int, rallyFrames int, physicsValidFrames int, totalDetections int, validTrajectories int, averageDetectionsPerFrame double, averageConfidence double, processingDuration double, framesPerSecond double"
QUALITY = "overallQuality double, averageRSquared double, trajectoryConsistency double, physicsValidationRate double, movementClassificationAccuracy double, confidenceDistribution struct<high:int,medium:int,low:int>"
PERFORMANCE = "averageFPS double, peakMemoryUsageMB double, averageMemoryUsageMB double, processingOverheadPercent double"
POINT = "timestamp double, position struct<x:double,y:double>, velocity double, acceleration double, confidence double"
TRAJECTORY = f"id string, startTime double, endTime double, points array<struct<{POINT.replace(' struct', ':struct').replace(' double', ':double')}>>, rSquared double, movementType string, confidence double, quality double"


def _inner(schema: str) -> str:
    """A column list as the inside of a struct."""
    out, depth = [], 0
    for part in schema.replace(", ", ",").split(","):
        out.append(part if depth else part.replace(" ", ":", 1))
        depth += part.count("<") - part.count(">")
    return ",".join(out)


#: A processing document; keys that are not named are ignored.
DOCUMENT = (
    f"id string, videoId string, processingVersion string, processingDate timestamp, rallySegments array<struct<{_inner(SEGMENT)}>>, "
    f"processingStats struct<{_inner(STATS)}>, qualityMetrics struct<{_inner(QUALITY)}>, performanceMetrics struct<{_inner(PERFORMANCE)}>, "
    f"trajectoryData array<struct<{_inner(TRAJECTORY)}>>, corrupt string"
)
DOCUMENT_DEFAULTS = {"processingVersion": "1.0"}
VIDEO = "id string, fileName string, customName string, folderPath string, createdDate double, fileSize bigint, duration double, isProcessed boolean, hasProcessingMetadata boolean, originalVideoId string, processedVideoIds array<string>"
FOLDER = "id string, name string, path string, parentPath string, createdDate double, modifiedDate double"
MANIFEST = f"folders map<string,struct<{_inner(FOLDER)}>>, videos map<string,struct<{_inner(VIDEO)}>>, version string, contentVersion int, corrupt string"
TRIM = "rotation double, zoom double, panX double, panY double, before double, after double"
TRIM_DEFAULTS = {"rotation": 0.0, "zoom": 1.0, "panX": 0.0, "panY": 0.0, "before": 0.0, "after": 0.0}
EVIDENCE = "time double, hasBall boolean, isProjectile boolean, detections array<struct<x:double,y:double,width:double,height:double,confidence:double>>, trackX double, trackY double, rSquared double, gravitySignature double, movementType string, rejectionReason string"
LABELS = "videoId string, labels array<struct<start:double,end:double>>"
#: The manifest counts seconds from 2001-01-01.
REFERENCE_DATE = 978_307_200
