"""Explicit schemas of the documents that captures come with; nothing is inferred."""

from __future__ import annotations

_VEC = "struct<x:double,y:double,z:double>"
DOME = (
    "label string, notes string, imageWidth double, domeDiameter double, verticalOffset double, lightConfiguration string, "
    f"directions array<{_VEC}>, positionsSphere array<{_VEC}>, positions3d array<{_VEC}>, ledAdjust array<struct<r:double,g:double,b:double>>"
)
_LENS = "struct<focal35equivalent:boolean,focalLength:double,pixelSizeX:double,pixelSizeY:double,principalOffsetX:double,principalOffsetY:double,k1:double,k2:double,p1:double,p2:double>"
_RECT = "struct<left:int,top:int,width:int,height:int>"
_DOME = "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in DOME.split(", ")) + ">"
_SPHERE = f"struct<center:array<double>,radius:double,smallradius:double,inner:{_RECT},lights:array<array<double>>,directions:array<array<double>>,border:array<array<double>>>"
PROJECT = (
    "version int, authors array<string>, platform string, created string, width int, height int, folder string, "
    f"lens {_LENS}, dome {_DOME}, images array<struct<filename:string,skip:boolean,visible:boolean>>, "
    "crop struct<left:int,top:int,width:int,height:int,angle:double>, "
    f"spheres array<{_SPHERE}>, measures array<struct<unit:string,length:double,first:array<double>,second:array<double>>>, "
    f"aligns array<struct<rect:{_RECT},offsets:array<array<double>>>>, whites array<struct<rect:{_RECT},r:double,g:double,b:double>>, forcedInputColorspace string"
)
INFO = (
    "width int, height int, format string, type string, colorspace string, sigma double, resolution int, pixelSizeInMM double, nplanes int, yccplanes array<int>, "
    "quality int, colorprofile string, lights array<double>, basis array<int>, materials array<struct<range:array<double>,scale:array<double>,bias:array<double>>>"
)
