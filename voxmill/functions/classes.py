"""Class tables of the data sets. Longer lists (scenes with 200 classes) are given by the user as a table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

#: Raw labels of driving scans.
LIDAR_NAMES = {
    0: "unlabeled", 1: "outlier", 10: "car", 11: "bicycle", 13: "bus", 15: "motorcycle", 16: "on-rails", 18: "truck", 20: "other-vehicle",
    30: "person", 31: "bicyclist", 32: "motorcyclist", 40: "road", 44: "parking", 48: "sidewalk", 49: "other-ground", 50: "building",
    51: "fence", 52: "other-structure", 60: "lane-marking", 70: "vegetation", 71: "trunk", 72: "terrain", 80: "pole", 81: "traffic-sign",
    99: "other-object", 252: "moving-car", 253: "moving-bicyclist", 254: "moving-person", 255: "moving-motorcyclist", 256: "moving-on-rails",
    257: "moving-bus", 258: "moving-truck", 259: "moving-other-vehicle",
}
#: The classes that are kept, in the order of their new labels 1..19.
LIDAR_CLASSES = ("road", "sidewalk", "parking", "other-ground", "building", "car", "truck", "bicycle", "motorcycle", "other-vehicle", "vegetation", "trunk", "terrain", "person", "bicyclist", "motorcyclist", "fence", "pole", "traffic-sign")
#: Raw ids of the twenty scene classes, in the order of their new labels from 0 (unlabeled).
SCENE_IDS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 24, 28, 33, 34, 36, 39)
#: Shape categories and how many parts each has.
PARTS = {"Aero": 4, "Bag": 2, "Cap": 2, "Car": 4, "Chair": 4, "EarPhone": 3, "Guitar": 3, "Knife": 2, "Lamp": 4, "Laptop": 2, "Motor": 6, "Mug": 2, "Pistol": 3, "Rocket": 3, "Skate": 3, "Table": 3}

#: The folder that holds each shape category.
FOLDERS = {
    "Aero": "02691156", "Bag": "02773838", "Cap": "02954340", "Car": "02958343", "Chair": "03001627", "EarPhone": "03261776", "Guitar": "03467517", "Knife": "03624134",
    "Lamp": "03636649", "Laptop": "03642806", "Motor": "03790512", "Mug": "03797390", "Pistol": "03948459", "Rocket": "04099429", "Skate": "04225987", "Table": "04379243",
}


def lidar_names(spark: SparkSession) -> DataFrame:
    """(id, name) for ``remap_lidar_labels``."""
    return spark.createDataFrame(list(LIDAR_NAMES.items()), "id long, name string")


def scene_classes(spark: SparkSession, ids: tuple[int, ...] = SCENE_IDS) -> DataFrame:
    """(class_id, index) for ``remap_labels``; any list of ids can be given."""
    return spark.createDataFrame([(c, k) for k, c in enumerate(ids)], "class_id int, index int")


def part_offsets(spark: SparkSession) -> DataFrame:
    """(category, shift): where the parts of each category begin in one numbering of all."""
    starts = [0, *accumulate(PARTS.values())]
    return spark.createDataFrame(list(zip(PARTS, starts)), "category string, shift long")


def part_folders(spark: SparkSession) -> DataFrame:
    """(folder, category): listings of shapes name folders, labels and tables of parts name categories."""
    return spark.createDataFrame([(f, c) for c, f in FOLDERS.items()], "folder string, category string")
